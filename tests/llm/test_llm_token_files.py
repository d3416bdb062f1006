import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from incidentry.llm import token_files
from incidentry.llm.common import open_folder
from incidentry.session import scratch_path
from llm_cases import FOLDER, awkward, empty
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def check(docs):
    encode, rows = plain(), [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = sorted(token_files.round_trip(docs, PATH).collect(), key=lambda r: r["start"])
    ids = [r["key"] for r in found]
    assert [i for i in ids if i is not None] == sorted(i for i, _ in rows if i is not None)
    assert ids.count(None) == sum(i is None for i, _ in rows) and None not in ids[: len(ids) - ids.count(None)]
    start, arrays = 0, []
    for r in found:
        array = np.array(r["ids"], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(array), zlib.crc32(array.tobytes()))
        start += len(array)
        arrays.append((str(r["key"]), list(r["ids"])))
    assert sorted(arrays) == sorted((str(i), encode(t or "") + [0]) for i, t in rows)


def test_documents(spark):
    check(spark.read.parquet(f"{FOLDER}/documents.parquet"))


def test_awkward_rows(spark):
    check(awkward(spark))


def test_empty_table(spark):
    assert token_files.round_trip(empty(spark), PATH).count() == 0


def test_files_roll_and_single_documents_are_read(spark, monkeypatch):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    folder = scratch_path(spark, "tokens-test")
    listed = token_files.write(docs, folder, PATH).collect()
    files, root = open_folder(folder)
    dictionary = files.open_input_stream(f"{root}/dictionary.zdict", compression=None).read()
    assert len(dictionary) > 1000
    texts, encode = {r["doc_id"]: r["text"] for r in docs.collect()}, plain()
    reader = token_files.Reader(files, f"{root}/{listed[0]['file']}", dictionary)
    for place in (0, len(reader.keys) - 1):
        assert reader.ids(place).tolist() == encode(texts[reader.keys[place]]) + [0]
    with pytest.raises(ValueError, match="another dictionary"):
        token_files.Reader(files, f"{root}/{listed[0]['file']}", dictionary + b"x")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\x0b\x1c 　\x00'sItdé.,9<|>"), st.characters(codec="utf-8")), max_size=40))
def test_pieces_encode_as_the_whole_text(text):
    tool = token_files.encoder(PATH)
    assert np.frombuffer(tool.encode(text), tool.kind).tolist() == plain_ids(text)


_PLAIN = []


def plain_ids(text):
    if not _PLAIN:
        _PLAIN.append(plain())
    return _PLAIN[0](text)


SPACES = ["foo", "\u00a0", "bar", "\t", "a\u00a0", "\u00a0b", " ", "\r", "\u3000", "x ", "\n", "\x85", "end"]


def test_texts_of_white_space_only_among_others(spark):
    check(spark.createDataFrame(list(enumerate(SPACES)), "doc_id bigint, text string").coalesce(1))
    tool = token_files.Encoder(PATH)
    assert [np.frombuffer(data, tool.kind).tolist() for data in tool.encode_all(SPACES)] == list(map(plain_ids, SPACES))


def test_a_lost_line_feed_has_pieces_encoded_apart():
    tool = token_files.Encoder(PATH)
    pieces = ["foo", "\u00a0", "bar"]
    assert [np.frombuffer(tool._encoded(pieces)[piece], tool.kind).tolist() for piece in pieces] == list(map(plain_ids, pieces))


ADDED = ["a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|> y\n<|endoftext|>", "<|endoftext |>", "<|endoftext|", "|>", "plain words"]


def test_added_tokens_are_one_id_as_by_default(spark):
    encode = Tokenizer.from_file(PATH).encode
    expected = [encode(text, add_special_tokens=False).ids for text in ADDED]
    assert [ids.count(50256) for ids in expected] == [1, 1, 2, 0, 0, 0, 0]
    tool = token_files.Encoder(PATH)
    assert [np.frombuffer(data, tool.kind).tolist() for data in tool.encode_all(ADDED)] == expected
    docs = spark.createDataFrame(list(enumerate(ADDED)), "doc_id bigint, text string")
    found = sorted(token_files.round_trip(docs, PATH).collect(), key=lambda r: r["start"])
    assert [list(r["ids"]) for r in found] == [ids + [0] for ids in expected]


@pytest.mark.parametrize("kind", ["smallint", "string", "decimal(9,2)", "date"])
def test_ids_of_other_types(spark, kind):
    made = "date_add(date'2024-01-01', i)" if kind == "date" else "i"
    docs = spark.sql(f"SELECT CAST({made} AS {kind}) AS doc_id, concat('text ', i) AS text FROM (SELECT explode(sequence(1, 12)) AS i)")
    found = token_files.round_trip(docs, PATH)
    assert found.schema["key"].dataType == docs.schema["doc_id"].dataType
    order = [r["doc_id"] for r in docs.orderBy("doc_id").collect()]
    assert [r["key"] for r in found.orderBy("start").collect()] == order


def test_held_ids_are_bounded(monkeypatch):
    encoder = token_files.Encoder(PATH)
    monkeypatch.setattr(token_files, "REMEMBERED_BYTES", 2000)
    for i in range(50):
        assert encoder.encode(f"word{i} " + "x" * 300) == encoder._ids(f"word{i} " + "x" * 300).tobytes()
    assert encoder.held <= 2000


def test_ids_are_left_out_where_not_asked_for(spark):
    docs = spark.createDataFrame([(i, "a b c " * 500) for i in range(6)], "doc_id bigint, text string")
    whole, counted = (token_files.round_trip(docs, PATH, with_ids=wanted).orderBy("key").collect() for wanted in (True, False))
    assert [r[:4] for r in whole] == [r[:4] for r in counted] and {len(r["ids"]) for r in counted} == {0} and len(whole[0]["ids"]) > 1000
