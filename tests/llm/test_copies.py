import hashlib
import random

from stayline.llm import copies

SCHEMA = "doc_id long, text string, keep_id string, extra int, group_size string"


def normal(text):
    return (text or "").encode().lower().decode()


def brute(data):
    groups = {}
    for doc_id, text, *_ in data:
        groups.setdefault(normal(text), []).append(doc_id)
    rows = []
    for doc_id, text, *_ in data:
        group = groups[normal(text)]
        known = [i for i in group if i is not None]
        keep = max(known) if known else None
        rows.append((doc_id, keep, len(group), doc_id == keep, hashlib.sha256(normal(text).encode()).hexdigest()))
    return sorted(rows, key=str)


def hand_made():
    rng = random.Random(3)
    texts = ["Same", "sAME", "same", "", None, "É", "é", "É", "x" * 200_000, "X" * 200_000, "y" * 200_000]
    data = [(i, t) for i, t in enumerate(texts)] + [(None, "same"), (None, "alone"), (None, "twice"), (None, "twice")]
    data += [(50, "again"), (50, "again"), (7, "other text, same id")]
    data += [(100 + i, "hot text") for i in range(300)]
    data += [(1000 + i, f"text {rng.randrange(250)}") for i in range(400)]
    return [(*r, "a", 1, "b") for r in data]


def found_by(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_groups_by_brute_force(spark, rows):
    data = hand_made()
    docs = rows(data, SCHEMA).repartition(5)
    wanted = brute(data)
    assert found_by(copies.copy_groups(docs)) == wanted
    # a filter of a few words calls most rows possible, one that is not broadcast is joined: same result
    assert found_by(copies.copy_groups(docs, bits_per_row=1)) == wanted
    assert found_by(copies.copy_groups(docs, broadcast_words=0)) == wanted


def test_one_row_of_each_text_stays(spark, rows):
    data = hand_made()
    kept = copies.drop_copies(rows(data, SCHEMA).repartition(5))
    assert kept.columns == ["doc_id", "text", "keep_id", "extra", "group_size"]
    found = kept.select("doc_id", "text").collect()
    wanted = {}
    for doc_id, text, *_ in data:
        key = normal(text)
        if key not in wanted or (wanted[key] is None) or (doc_id is not None and doc_id > wanted[key]):
            wanted[key] = doc_id
    assert sorted(((r.doc_id, normal(r.text)) for r in found), key=str) == sorted(((i, t) for t, i in wanted.items()), key=str)


def test_unique_rows_are_not_tested_further(spark, rows):
    docs = rows([(i, f"text number {i}") for i in range(3000)], "doc_id long, text string")
    digests = docs.select("doc_id", copies.text_digest(docs["text"]).alias("__sha"))
    words = 3000 * copies.BITS_PER_ROW // 64
    marked = copies._marked(digests, words).join(copies.repeated_bits(digests, words), "__word")
    assert marked.where("(__bits & __mask) = __mask").count() < 3000 * 0.02


def test_no_python_in_the_plan(spark, rows):
    docs = rows([(1, "a"), (2, "a")], "doc_id long, text string")
    plan = copies.copy_groups(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_empty_table(spark, rows):
    docs = rows([], "doc_id long, text string")
    assert copies.copy_groups(docs).count() == 0
    assert copies.drop_copies(docs).count() == 0
