import hashlib

import pytest

from stayline.llm import pieces

TEXTS = [
    None,
    "",
    " ",
    "  two spaces\n\nand\tlines \r\n",
    "Hello world, hello (world)... 12,345 x²·y",
    "▁ mark and <0x41> \x00 nul 日本語 🎉 é",
    "a" * 1000 + "漢" * 200,
    "word " * 20_000,
    "The ascii-only state_of the art's",
]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(pieces.model_path())


def best(word, v):
    paths = [(0.0, 0, (), ())]
    for end in range(1, len(word) + 1):
        into = []
        for begin in range(max(0, end - v.longest), end):
            piece = word[begin:end]
            if piece in v.pieces:
                ids, score = (v.pieces[piece][0],), v.pieces[piece][1]
            elif end - begin == 1:
                ids, score = tuple(v.byte_ids[b] for b in piece.encode()), v.byte_cost
            else:
                continue
            total, fewer, lengths, before = paths[begin]
            into.append((total + score, fewer - len(ids), (end - begin, *lengths), before + ids))
        paths.append(max(into))
    return paths[-1][3]


def test_words_cover_the_text():
    for text in TEXTS:
        assert "".join(pieces.split_words(text)) == (f" {text}" if text else "")


@pytest.mark.parametrize("word", [pieces._WORD, pieces._WHOLE])
@pytest.mark.parametrize("factor", [pieces._FACTOR, 0])
def test_numbered_words_are_those_of_each_text(word, factor, monkeypatch):
    monkeypatch.setattr(pieces, "_WINDOW", 100)
    monkeypatch.setattr(pieces, "_FACTOR", pieces.np.uint64(factor))  # with 0 all words share a hash
    texts = [*TEXTS, " \n \n\n  x", "\n", *TEXTS[::-1], None]
    lengths, tokens, known = pieces._numbered(texts, word)
    cut = [pieces.split_words(t, word) for t in texts]
    flat = [w for words in cut for w in words]
    assert lengths.tolist() == [len(words) for words in cut]
    assert known == list(dict.fromkeys(flat))
    assert [known[i] for i in tokens] == flat


def test_numbered_nothing():
    lengths, tokens, known = pieces._numbered([None, ""], pieces._WORD)
    assert (lengths.tolist(), tokens.tolist(), known) == ([0, 0], [], [])


def test_front_coding_gives_the_words_back():
    for words in ([], [""], sorted({"", "a", "a\x00", "a\x00b", "x" * 40 + "y", "x" * 40 + "z", "漢字", "漢字仮名", "🎉"})):
        assert pieces._cut(pieces._joined(words)) == words


def test_decoding_takes_null_and_empty_ids(rows, vocabulary, monkeypatch):
    monkeypatch.setattr(pieces, "_WINDOW", 7)
    texts = ["", "漢 and é 🎉", "word " * 9, None]
    lists = [[i for w in pieces.split_words(t) for i in best(w, vocabulary)] if t is not None else None for t in texts]
    found = pieces.decode(rows(list(enumerate(lists)), "doc_id long, ids array<int>")).collect()
    assert {r.doc_id: r.text for r in found} == {i: t or "" for i, t in enumerate(texts)}


def test_paths_by_brute_force_and_round_trip(rows, vocabulary):
    data = [(i, t, "x", 0) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], None, 1), (None, "no id", "x", 2)]
    docs = rows(data, "doc_id long, text string, word string, ids int").repartition(3)
    found = pieces.decode(pieces.encode(docs, block_chars=3_000, shard_words=10)).collect()
    assert len(found) == len(data)
    for r in found:
        text = "no id" if r.doc_id is None else TEXTS[r.doc_id]
        words = pieces.split_words(text)
        assert r.ids == [i for w in words for i in best(w, vocabulary)]
        assert r.text == (text or "")
        assert (r.n_words, r.n_pieces) == (len(words), len(r.ids))


def test_cutting_at_words_loses_no_piece(vocabulary):
    crossing = [p for p in vocabulary.pieces if p.strip(" ") and len(pieces._WORD.findall(p)) > 1]
    assert len(crossing) <= 1  # one rare sign before a full stop


WHOLE = [
    "def f(x):\n" + " " * 16 + "return  x" + " " * 37 + "# end   \n\n" + " " * 8,
    "a   1\t\t  2  |" + "-" * 150 + "|" + " " * 140 + "\n" + "=" * 64,
    "漢字仮名交文日本語" * 20 + "ab" * 40 + "QWxhZGRpbjpvcGVuIHNlc2FtZQ" * 5,
    "12 m². and x²" + "é" * 62 + "in" * 30 + " " * 17,
]


def test_paths_are_those_of_whole_texts(rows, vocabulary):
    docs = rows(list(enumerate(WHOLE)), "doc_id long, text string")
    found = pieces.decode(pieces.encode(docs, block_chars=300, shard_words=10)).collect()
    assert len(found) == len(WHOLE)
    for r in found:
        assert tuple(r.ids) == best(f" {WHOLE[r.doc_id]}", vocabulary)
        assert r.text == WHOLE[r.doc_id]


def test_round_trip_tells_what_was_decoded(rows):
    data = [(i, t, b"x") for i, t in enumerate(TEXTS + WHOLE)] + [(4, TEXTS[4], None), (None, "no id", None)]
    docs = rows(data, "doc_id long, text string, digest binary").repartition(3)
    found = pieces.round_trip(docs, block_chars=3_000, shard_words=10).collect()
    assert len(found) == len(data)
    for r in found:
        text = "no id" if r.doc_id is None else (TEXTS + WHOLE)[r.doc_id]
        assert r.text_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
        assert r.round_trip is True


def test_the_query_decodes_every_document(spark):
    from stayline.llm.queries import op5_sentencepiece

    found = op5_sentencepiece(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert found.where("round_trip").count() == docs.count()


def test_no_piece_crosses_a_cut(vocabulary):
    assert not [p for p in vocabulary.pieces if len(pieces._WORD.findall(p)) > 1]
    assert vocabulary.word is pieces._WORD


def test_empty(rows):
    assert pieces.encode(rows([], "doc_id long, text string")).count() == 0


def test_word_lists_are_shuffled_once(rows):
    """For the distinct words and for their answers."""
    docs = rows([(i, f"one word of text {i} and another") for i in range(20)], "doc_id long, text string")
    found = pieces.round_trip(docs)
    assert all(r["round_trip"] for r in found.collect())
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()
