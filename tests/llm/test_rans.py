"""Token files: batches of texts, long documents in parts, repeated and null doc_ids."""

import random
import tempfile

import numpy as np
import pyarrow as pa
import pytest

from fieldwright.llm import rans

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def path():
    return public_tokenizers.path("byte_bpe_50k.json")


def nasty_texts():
    r = random.Random(3)
    parts = ["a", "word", "Word", " ", "  ", "\n", "\t", ".", ",", "it's", "12", "é", "日本", "😀", "\u0085", "\x1c", "_", "<|endoftext|>", "!?", "ß", " "]
    return [None, "", " ", "  a", "a ", *("".join(r.choice(parts) + r.choice(["", " ", " "]) for _ in range(r.randrange(1, 30))) for _ in range(3000))]


def test_a_batch_gives_the_library_s_ids(path):
    encoder, texts = rans.Encoder(path), nasty_texts()
    ids, n = encoder.encode_all(pa.array(texts, pa.string()))
    assert n.sum() == len(ids)
    ends = np.cumsum(n)
    for t, start, end in zip(texts, ends - n, ends):
        assert ids[start:end].tolist() == encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [0], repr(t)


def test_another_splitting_is_encoded_whole(path, tmp_path):
    import json

    made = json.load(open(path, encoding="utf-8"))
    made["pre_tokenizer"]["use_regex"] = False
    other = tmp_path / "other.json"
    other.write_text(json.dumps(made), encoding="utf-8")
    encoder = rans.Encoder(str(other))
    assert not encoder.divisible
    ids, n = encoder.encode_all(pa.array(["the quick, brown\nfox", None]))
    assert ids.tolist() == encoder.tokenizer.encode("the quick, brown\nfox", add_special_tokens=False).ids + [0, 0]


def test_long_documents_decode_in_parts_and_hot_ids_are_spread(spark, path):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    long = " ".join(word() for _ in range(120_000))
    rows = [(i, " ".join(word() for _ in range(20))) for i in range(300)] + [(150, long)] + [(7, "same text")] * 400 + [(None, "none")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    folder = tempfile.mkdtemp(prefix="spark-ids-")
    rans.write(docs, path, folder)
    found = sorted(rans.read(spark, folder).collect(), key=lambda x: x["start"])
    assert [x["doc_id"] for x in found] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    whole = b"".join(x["ids"] for x in found)
    parts = sorted(rans.read_parts(spark, folder).collect(), key=lambda x: x["start"])
    assert b"".join(x["ids"] for x in parts) == whole and len(whole) == 4 * sum(x["n_tokens"] for x in found)
    assert max(len(x["ids"]) for x in parts) <= 4 * rans.LANES * rans.CHECKPOINT < 4 * max(x["n_tokens"] for x in found)
    per_range = [x[0] for x in spark.read.parquet(f"{folder}/blocks").groupBy("part").sum("n").select("sum(n)").collect()]
    assert len(per_range) > 3
