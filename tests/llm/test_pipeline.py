import corpus_pipeline
from stayline.llm import jaccard, pieces, quality, secrets
from stayline.session import stage


def test_stages_in_order_and_their_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "secret_scans", "mixing", "encoding"]
    seen = {"documents": docs}
    for name, function in corpus_pipeline.STAGES:
        before = docs
        docs = stage(function(spark, docs, sf), name)
        seen[name] = docs
        if name != "encoding":
            assert docs.dtypes == before.dtypes
    kept = {r.doc_id: r.text for r in seen["quality_rules"].collect()}
    for r in seen["documents"].collect():
        base, _ = quality.statistics((r.text or "").encode())
        if quality._failed(base):
            assert r.doc_id not in kept
        elif r.doc_id in kept:
            assert kept[r.doc_id] == r.text
    unique = seen["near_duplicates"]
    assert jaccard.near_duplicates(unique).where("class_id <> doc_id or n_links > 0").count() == 0
    classes = jaccard.near_duplicates(seen["quality_rules"])
    assert unique.count() == classes.select("class_id").distinct().count()
    found = secrets.find_places(seen["secret_scans"])
    assert secrets.digest(found, secrets.rejected_from(found)).where("spans <> ''").count() == 0
    mixed = {}
    for r in seen["mixing"].collect():
        mixed.setdefault(r.doc_id, []).append(r.text)
    clean = {r.doc_id: r.text for r in seen["secret_scans"].collect()}
    assert set(mixed) <= set(clean)
    assert all(len(texts) <= 3 and set(t.split()) <= set(clean[i].split()) for i, texts in mixed.items() for t in texts)
    decoded = sorted(r.text for r in pieces.decode(seen["encoding"]).collect())
    assert decoded == sorted(t for texts in mixed.values() for t in texts)


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").columns == ["doc_id", "n_words", "n_pieces", "ids"]
    assert corpus_pipeline.ORACLE_SQL is None
