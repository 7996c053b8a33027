import corpus_pipeline
from hushframe.llm.common import new_path


def test_stages_over_a_small_table(spark):
    sf = new_path(spark, "sf")
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(120):
        text = " ".join(words[(i * 7 + j * (1 + i % 13)) % 400] for j in range(40))
        rows.append((i, text + f"\nown line {i} of this text", "en", f"s{i % 3}", len(text)))
    rows += [(200, rows[5][1], "en", "s0", 9), (201, rows[6][1].replace("\nown", "\nour"), "en", "s1", 9), (202, "", "en", "s1", 0), (203, None, None, None, None)]
    rows += [(300 + i, "$$$ ### " * 30, "en", "s2", 240) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 300)) for r in rows if r[0] % 2 or r[0] < 100], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        docs.write.parquet(path := new_path(spark, name))
        docs = spark.read.parquet(path)
        kept[name] = docs
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in kept.items()}
    assert not any(i >= 300 for i in ids["quality"]) and set(range(120)) <= ids["quality"]
    assert 200 not in ids["lines"] and {5, 6, 201} <= ids["lines"]
    assert kept["lines"].where("doc_id = 201").first().text == "our line 6 of this text"
    assert ids["near_duplicates"] <= ids["lines"] and set(range(120)) <= ids["near_duplicates"]
    assert ids["packing"] == ids["mixing"] and len(ids["mixing"]) > 30
    assert corpus_pipeline.run(spark, sf).count() == kept["packing"].count()
