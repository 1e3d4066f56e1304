from tests.conftest import SF


def test_stages(spark):
    import corpus_pipeline
    from tests.llm import brute

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for (name, stage), after in zip(corpus_pipeline.STAGES, range(5)):
        before = docs.collect()
        docs = stage(spark, docs, SF).cache()
        rows = docs.collect()
        if after < 4:
            assert docs.columns == columns
        ids = {r.doc_id for r in rows}
        if name == "language":
            assert all(r.doc_id in ids for r in before if len(r.text) > 200)
        elif name == "lines":
            want = brute.dedup_lines([(r.doc_id, r.text) for r in before], 20)
            assert all(r.text == want[r.doc_id] for r in rows)
            assert ids == {d for d, t in want.items() if t.strip()}
        elif name == "near copies":
            want = brute.ngram_components([(r.doc_id, r.text) for r in before], 5, 80)
            assert ids == {d for d, (_, c) in want.items() if d == c}
        elif name == "mixing":
            assert ids == {r.doc_id for r in before}
        else:
            assert ids == {r.doc_id for r in before}
            seen = [(r.bin, r.doc_id) for r in rows if "-full-" not in r.bin]
            assert len(seen) == len(set(seen))


def odd_documents(spark):
    """Null and empty texts, repeated rows and ids, and columns that are called like what the stages add."""
    text = "The old harbour was quiet in the morning and the boats lay still on the water.\nNobody spoke."
    other = "A second text about the weather in the hills, which is colder than people think in the summer months."
    rows = [(1, text), (5, text), (5, other), (7, None), (8, ""), (9, "12345"), (1, text), (None, other + " It has more words."), (10, "x"), (11, "word " * 20000)]
    rows = [(d, t, "en", "s" if i % 2 else None, None if t is None else len(t), 1, 2, 3) for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, copies int, row int, language int")


def test_stages_on_odd_rows(spark):
    import corpus_pipeline

    docs = odd_documents(spark)
    for (name, stage), after in zip(corpus_pipeline.STAGES, range(5)):
        got = stage(spark, docs, SF)
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        if after < 4:
            assert got.columns == docs.columns, name
            assert all((r.copies, r.row, r.language) == (1, 2, 3) for r in got.collect()), name
        else:
            assert got.where("piece = 0").count() == 10  # a long text has several pieces


def test_near_copies_of_repeated_ids(spark):
    import corpus_pipeline

    docs = odd_documents(spark)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect())
    texts = {t for _, _, t in got}
    assert texts == {r.text or "" for r in docs.collect()}  # no text is lost
    assert [d for _, d, t in got if t.startswith("The old")] == [1]  # and one row of each group stays
    mixed = corpus_pipeline.mix_sources(spark, docs, SF).collect()
    assert len(mixed) >= docs.count() and {r.text for r in mixed} == {r.text for r in docs.collect()}


def test_run(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "bin", "position", "offset"]
    rows = got.collect()
    bins = {}
    for r in rows:
        bins.setdefault(r.bin, []).append(r)
    assert rows and all(sum(r.length for r in b) <= 4096 for b in bins.values())
    known = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert {r.doc_id for r in rows} <= known


def test_language_stage_rejects_what_it_cannot_tell(spark):
    import random
    import string

    import corpus_pipeline

    rng = random.Random(1)
    words = lambda n, letters: " ".join("".join(rng.choices(letters, k=rng.randrange(2, 9))) for _ in range(n))
    junk = [
        words(60, string.ascii_lowercase), words(60, "абвгдежзиклмнопрст"), "".join(rng.choices(string.ascii_letters + "+/", k=400)), "x" * 900,
        "12345 $$$ 6789 ### x", "def f(x):\n    for i in range(len(x)):\n        if x[i] > max_value: max_value = x[i]\n    return sorted(x, key=lambda k: k.name)\nimport numpy as np\n" * 3,
        "Słońce świeci nad starym miastem, podczas gdy dzieci bawią się na placu przy fontannie, a starsi rozmawiają o dawnych czasach z wielką nostalgią",
        "Aurinko paistaa vanhan kaupungin yllä, kun lapset leikkivät aukiolla suihkulähteen lähellä ja vanhukset puhuvat menneistä ajoista",
        "Солнце светит над старым городом, пока дети играют на площади у фонтана",
    ]
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(junk)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs.unionByName(more), SF).collect()}
    assert [t for i, t in enumerate(junk) if -1 - i in kept] == []
    clean = {r.doc_id for r in docs.collect()}
    assert len(clean & kept) >= 0.99 * len(clean)
