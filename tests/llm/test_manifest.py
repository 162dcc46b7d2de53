import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from stayline.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, node int, position string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h("".join(below[i : i + 2])) for i in range(0, len(below), 2)])
    return levels


def siblings(levels, i):
    for level in levels[:-1]:
        run = level[i - i % 2 : i - i % 2 + 2]
        yield i % 2, run[:i % 2] + run[i % 2 + 1 :]
        i //= 2


def brute(data):
    langs = {}
    for row in data:
        langs.setdefault(row[2], []).append(row)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for x in order:
        langs[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, bytes.fromhex(leaf(r))))
    trees = {x: tree([leaf(r) for r in langs[x]]) for x in order}
    top = tree([trees[x][-1][0] for x in order])
    out = []
    for k, x in enumerate(order):
        for i, row in enumerate(langs[x]):
            path = [*siblings(trees[x], i), *siblings(top, k)]
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None
            node = leaf((*row[:3], row[3] + 1, row[4])) if tampered else leaf(row)
            for place, others in path:
                node = h("".join(others[:place] + [node] + others[place:]))
            proof = "".join(s for _, others in path for s in others)
            out.append((row[0], leaf(row), trees[x][-1][0], top[-1][0], h(proof), node, node == top[-1][0]))
    return sorted(out, key=str)


def digest(frame):
    rows = frame.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", "").cast("binary"), 256), "folded_root", "verified"
    ).collect()
    return sorted(map(tuple, rows), key=str)


def built(docs, **options):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return manifest.manifest(docs, tampered, {"n_chars": F.col("n_chars").cast("decimal(38,0)") + 1}, **options)


DATA = (
    [(i, "s", "en", i, f"text é {i}") for i in range(203)]
    + [(1000 + i, None, "de", None if i % 3 else 5, None) for i in range(64)]
    + [(2000 + i, "", None, 2**63 - 1, "") for i in range(33)]
    + [(3000, "s", "fr", 9, "x" * 100_000), (3001, "s", "É", 1, "one"), (3002, "s", "", 1, "no language")]
    + [(None, "s", "en", 3, "no id"), (None, "t", "en", 3, "no id"), (5, "s", "en", 5, "again"), (6, "s", "en", 6, "text é 6")]
)


@pytest.mark.parametrize("block_levels", [1, 3, 12])
def test_by_brute_force(spark, rows, block_levels):
    docs = rows([(*r, "a", 1, "b") for r in DATA], SCHEMA).repartition(7)
    assert digest(built(docs, block_levels=block_levels)) == brute(DATA)


def test_versions_copy_only_ancestors(spark, rows):
    docs = rows([(*r, "a", 1, "b") for r in DATA], SCHEMA)
    for r in built(docs, block_levels=3).collect():
        assert r.copied_nodes == (0 if r.tampered_leaf is None else len(r.sides) + 1)
        assert len(r.proof) == len(r.sides.replace("-", ""))
    assert manifest.manifest(docs).where("not verified or tampered_leaf is not null").count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 8, 9])
def test_small_tables(spark, rows, n):
    data = [(i, "s", "en", i, "t") for i in range(n)]
    docs = rows([(*r, "a", 1, "b") for r in data], SCHEMA)
    assert digest(built(docs, block_levels=2)) == (brute(data) if n else [])
