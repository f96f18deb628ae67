"""Token counts of rows that share a doc_id, or have none, and whose texts agree in a hash of 32 bits."""

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bagdiv.llm import token_counts


def test_rows_of_one_id_and_one_hash(spark):
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(path)
    texts = ["word 50731", "word 307993"]
    rows = [(None, t) for t in texts] + [(7, t) for t in texts] + [(7, texts[0]), (None, None), (7, None), (7, "")]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, one string, size int")
    assert df.where("text like 'word%'").select(F.hash("text")).distinct().count() == 1
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False)), False) for i, t in rows]
    for head in (1 << 18, 0):
        got = sorted((tuple(r) for r in token_counts.token_counts(df, path, head=head).collect()), key=lambda r: (r[0] is None, r[1:]))
        assert got == sorted(want, key=lambda r: (r[0] is None, r[1:]))


def test_very_long_text(spark):
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    unit = " plain words of a very long text,"
    got = token_counts.token_counts(spark.createDataFrame([(1, unit * 600_000)], "doc_id long, text string"), path).first()
    assert got.n_bytes == 600_000 * len(unit) > 19_000_000 and got.over_limit
    assert got.n_tokens == 600_000 * len(Tokenizer.from_file(path).encode(unit, add_special_tokens=False))
