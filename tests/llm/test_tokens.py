"""BPE and token counts against the public libraries."""

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from timeloom.llm import bpe, tokencount

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
TEXTS = [
    None, "", " ", "a" * 5000, "ab" * 3000, "  \n\n\t  x", "日本語テキスト😀😀", "%" * 2000 + "$#@!" * 500, "<|endoftext|> hi", "é" * 1000, "\x01\x02ÿ", "don't I'll WE'RE", "=-" * 800,
    "ΑΣ ΟΔΟΣ", "İstanbul ŉ ǅ", "été ½ ² x", "a<|startoftext|>b<|endoftext|>", "<|ENDOFTEXT|>", "\x1ca\x85b", "1234 ٣٤ ⅷ", "ß ẞ ÀÉ", "_under_score__", "é decomposed", "The the THE theory of theft, thereof!",
]


def frame(spark, texts=TEXTS):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    rows += rows[-1:]  # a repeated row
    return spark.createDataFrame([*rows, (None, "null id", "x", 1)], "doc_id long, text string, ids string, n_tokens int")


def test_bpe_equals_the_library_and_round_trips(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode_documents(frame(spark), path, P.PATTERN, with_text=True)
    for r in got.collect():
        text = (TEXTS[r.doc_id] if r.doc_id is not None else "null id") or ""
        ids = own.encode_ordinary(text)
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded_text == text
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert got.count() == len(TEXTS) + 2
    back = bpe.decode_ids(got.select("doc_id", "ids"), path, P.PATTERN).join(frame(spark).select("doc_id", F.coalesce("text", F.lit("")).alias("t")), "doc_id")
    assert back.where("decoded_text <> t").count() == 0


def test_long_pieces_merge_as_short_ones():
    own = bpe.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for piece in (b"abcabcabd" * 25, b"aaaaaaa" * 30, bytes(range(97, 123)) * 8, b"thththehehe" * 20):
        ids = own.ranks.byte_id[list(piece)]
        assert own.ranks.merge_long(ids).tolist() == [x for x in own.ranks.merge_rows(ids[None, :])[0].tolist() if x >= 0]


def test_token_counts_equal_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = P.path("word_bpe_49k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    got = tokencount.count_tokens(frame(spark), path, common=5).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        text = (TEXTS[r.doc_id] if r.doc_id is not None else "null id") or ""
        assert (r.n_tokens, r.n_bytes) == (len(lib.encode(text, add_special_tokens=False).ids), len(text.encode())) and r.over_limit == (r.n_tokens > 2048)


@pytest.mark.parametrize("change", ["bracket", "plain", "no normalizer", "replace", "no pre-tokenizer", "lstrip", "word"])
def test_token_counts_by_other_rules(spark, tmp_path, change):
    import json

    tokenizers = pytest.importorskip("tokenizers")
    spec = json.load(open(P.path("word_bpe_49k.json")))
    extra = {"id": 49408, "content": "[EOS]", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
    if change in ("bracket", "lstrip", "word"):
        spec["added_tokens"].append(extra | {"lstrip": change == "lstrip", "normalized": change == "lstrip", "single_word": change == "word"})
    elif change == "plain":
        spec["added_tokens"] = []
    elif change == "no normalizer":
        spec["normalizer"] = None
    elif change == "no pre-tokenizer":
        spec["pre_tokenizer"] = None
    else:
        spec["normalizer"]["normalizers"][1]["content"] = "x"
    path = str(tmp_path / "own.json")
    json.dump(spec, open(path, "w"))
    lib = tokenizers.Tokenizer.from_file(path)
    texts = ["hello [EOS] world", "a[EOS]b", "x  [EOS]", "[eos] Hello", "Two  words\nthree", "", None, "<|endoftext|>[EOS]", "the THE"]
    got = tokencount.count_tokens(frame(spark, texts), path).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = (texts[r.doc_id] if r.doc_id is not None else "null id") or ""
        assert r.n_tokens == len(lib.encode(text, add_special_tokens=False).ids), text


def test_slabs_are_compressed_rows():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    known = np.array(["".join(rng.choice(list("etaoinsrhld"), rng.integers(2, 11))) for _ in range(20_000)])
    texts = [" ".join(known[(20_000 ** rng.random(500)).astype(int) - 1]) for _ in range(1200)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts, "n_bytes": list(map(len, texts))})
    got = list(tokencount._slabs(P.path("word_bpe_49k.json"))([batch]))
    assert sum(b.num_rows for b in got) > 1 and sum(b.nbytes for b in got) < 0.4 * sum(map(len, texts))  # 0.81 as plain lists


def test_slab_files_are_cut_by_bytes(spark):
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq

    def noise(batches):
        for batch in batches:
            for _ in range(batch.num_rows):
                yield pa.RecordBatch.from_pydict({"x": [os.urandom(1 << 20)]})

    table = tokencount.cut(spark.range(0, 64, 1, 1).mapInArrow(noise, "x binary"), **tokencount.SLAB_FILES)
    sizes = [f.row_group(k).total_byte_size for p in table.inputFiles() for f in [pq.ParquetFile(p.removeprefix("file:")).metadata] for k in range(f.num_row_groups)]
    assert sum(sizes) >= 64 << 20 and max(sizes) <= 24 << 20


def test_empty_tables(spark):
    none = frame(spark).where("false")
    assert bpe.encode_documents(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == tokencount.count_tokens(none, P.path("word_bpe_49k.json")).count() == 0
