import base64
import hashlib
import random
import re
import string

from stayline.llm import secrets

HEX = "0123456789abcdef"


def token(alphabet, n, seed):
    return "".join(random.Random(seed).choices(alphabet, k=n))


BASE62 = string.ascii_letters + string.digits
TEXTS = [
    None,
    "",
    "nothing to see, token = short and secret:",
    'öß token = "%s" end' % token(HEX, 40, 1),
    "PassWord: abcdefgh api_key='12345678' apikey=12345678 token=secret:abcdefgh",
    "AKIA" + "A1" * 6 + " AKIA" + "B" * 11 + " xAKIAAKIA" + "Z" * 12,
    token(HEX, 31, 2) + " " + token(HEX, 64, 3) + "g" + token(HEX, 32, 4),
    "key " + token(BASE62, 48, 5) + " and " + token(BASE62, 40, 6),
    "ordinary-words-joined-by-hyphens-in-2024-are-not-random",
    "http/www/example/com/archive/2021/index/page/file1",
    "tail " * 30_000 + "secret=" + token(BASE62, 20, 7),
    " ".join(f"token={token(BASE62, 9, i)}" for i in range(700)),
]


def brute(text):
    text = text or ""
    assign = re.compile(secrets.PATTERNS["assign"].replace("(?i:", "(?ai:"))
    spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[1]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(spans)


def written(spans):
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def test_base_spans_by_brute_force_and_random_tokens(rows):
    data = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], None, None), (None, "token=abcdefghi", "", 2)]
    docs = rows(data, "doc_id long, text string, spans string, n_hex int")
    found = secrets.find_places(docs)
    rows_found = secrets.digest(found, secrets.rejected_from(found)).collect()
    assert len(rows_found) == len(data)
    for r in rows_found:
        text = TEXTS[r.doc_id] if r.doc_id is not None else "token=abcdefghi"
        spans = brute(text)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in spans) for i in range(3))
        assert r.base_sha256 == hashlib.sha256(written(spans).encode()).hexdigest()
        assert {x for x in written(spans).split(",") if x} <= set(r.spans.split(","))
    by_id = {r.doc_id: r for r in rows_found}
    assert by_id[7].spans.count("random") == 2
    assert "random" not in by_id[8].spans + by_id[9].spans
    plan = secrets.digest(found, {})._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_redaction_and_empty_table(rows):
    docs = rows([(i, t, 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_chars long")
    clean = {r.doc_id: r for r in secrets.redact(docs).collect()}
    for i, text in enumerate(TEXTS):
        expected, at = text, 0
        if brute(text):
            expected = ""
            for start, _, end in brute(text):
                if start >= at:
                    expected += text[at:start] + secrets.REDACTED
                at = max(at, end)
            expected += text[at:]
        if i not in (6, 7):  # these hold random tokens beside the base spans
            assert clean[i].text == expected
            assert clean[i].n_chars == (len(expected) if expected != text else 7)
    assert clean[7].text == "key [redacted] and [redacted]"
    assert secrets.redact(rows([], "doc_id long, text string")).count() == 0


def test_false_discovery_threshold_by_definition():
    class Found:
        def __init__(self, counts):
            self.counts = counts

        def select(self, *_):
            return self

        groupBy = count = select

        def collect(self):
            class Row(dict):
                __getattr__ = dict.__getitem__

            return [Row(encoding=1, band=5, bin=b, count=n) for b, n in self.counts.items()]

    # 90 tokens far in the tail, 10 ordinary ones: the procedure rejects the tail only
    bars = secrets.rejected_from(Found({200: 90, 5: 10}), 0.01)
    assert 5 < bars[(1, 5)] <= 200
    # all look random: nothing is rejected
    assert secrets.rejected_from(Found({0: 50, 10: 50}), 0.01)[(1, 5)] > 200


def test_short_padded_and_digitless_keys_are_found(rows):
    keys = [base64.b64encode(random.Random(i).randbytes(16)).decode() for i in range(20)]
    keys += [token(BASE62, n, n) for n in (16, 19, 23)] + [token(string.ascii_letters, 24, 9)]
    docs = rows([(i, f"say {k} now") for i, k in enumerate(keys)], "doc_id long, text string")
    found = secrets.find_places(docs)
    got = {r.doc_id: r.spans for r in secrets.digest(found, secrets.rejected_from(found)).collect()}
    assert got == {i: f"random:4:{4 + len(k)}" for i, k in enumerate(keys)}


def test_redaction_reads_staged_places(spark, rows):
    docs = rows([(1, "password = abcdefgh12", 21), (2, None, None)], "doc_id long, text string, n_chars long")
    plan = secrets.redact(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "places-" in plan or "__places" in plan
    assert "regexp_extract_all" not in plan
