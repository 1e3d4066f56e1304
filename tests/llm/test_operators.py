import hashlib
import io
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quarrymap.llm import (
    fingerprint, language, lines, media, mixing, ngram_join, packing, pii, queries, spelling, tokenfile, tokens, toxicity, vectors,
)
from tests.conftest import SF
from tests.llm import brute

ODD = [
    (1, None), (2, ""), (3, "   "), (4, "a"), (5, "\n\n"), (6, "word " * 3000), (7, "x" * 9000), (8, "é中😀 <s> </s> ▁▁ a  b\t c "),
    (9, "12345 67 !!"), (10, "mail a@b.cc_x@d.e.f and 1.2.3.4.5.6.7.8 and +1 (202) 555-0143."), (11, "card 4111 1111 1111 1111, 4111-1111-1111-1112"),
    (12, "the same line of text here\nthe same line of text here"), (13, "the same line of text hexe\nanother line"), (None, "no id at all"),
    (4, "a"), (14, "<|endoftext|> \n \n x"), (15, "The SAME line of text hera"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(d, t, "en" if t and len(t) % 2 else None, None if d == 5 else "s", 1, 2, 3) for d, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, features int, bucket int")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words_of(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def texts_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_media_round_trip(spark, odd, empty, docs):
    for df in (odd, docs):
        got = media.media_columns(df.select("doc_id", "text", "source")).collect()
        assert len(got) == df.count()
        for r in got:
            payload = (r.text or "").encode()
            payload += bytes(-len(payload) % 64 if payload else 64)
            assert media.decode_png(bytes(r.media)).tobytes() == payload
            f = r.features
            assert f.ok and f.payload_sha256 == hashlib.sha256(payload).hexdigest() and f.tail_crc32 == zlib.crc32(payload[-64:])
            assert len(f.phash) == 8
    assert media.media_columns(empty.select("text")).count() == 0


def test_media_filters_and_damage(spark):
    rng = np.random.default_rng(1)
    for bpp in (1, 3, 4):
        image = rng.integers(0, 256, (12, 7 * bpp), np.uint8)
        raw = np.zeros((12, 7 * bpp + 1), np.uint8)
        kinds = [0, 1, 2, 2, 3, 4, 2, 1, 4, 3, 2, 0]
        for y, kind in enumerate(kinds):  # filter each row by the definition
            up = image[y - 1].astype(int) if y else np.zeros(7 * bpp, int)
            row = image[y].astype(int)
            left = np.concatenate([np.zeros(bpp, int), row[:-bpp]])
            corner = np.concatenate([np.zeros(bpp, int), up[:-bpp]])
            p = left + up - corner
            near = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
            guess = [0 * row, left, up, (left + up) // 2, near][kind]
            raw[y, 0], raw[y, 1:] = kind, (row - guess) % 256
        assert (media.unfilter(raw, bpp) == image).all()
    good = media.encode_png(media.payload_of("some text"))
    bad = [None, b"", good[:-3], good[:40] + bytes([good[40] ^ 1]) + good[41:], b"x" + good]
    df = spark.createDataFrame([(b,) for b in bad], "media binary").select(media.features_of("media").alias("f"))
    assert [r.f.ok for r in df.collect()] == [False] * len(bad)


def test_token_counts(spark, odd, empty, docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for df in (odd, docs):
        for r in tokens.token_counts(df, path).collect():
            assert r.n_tokens == len(model.encode(r.text or "")), r.text
    assert tokens.token_counts(empty, path).count() == 0
    rng, counter = random.Random(5), tokens.Counter(path)
    alphabet = list("ab c  \n\t▁é<s>.１ﬁ　\xa0") + ["</s>", "<unk>", "<0x0A>", "the ", "▁▁"]
    some = ["".join(rng.choices(alphabet, k=rng.randrange(20))) for _ in range(3000)]
    assert counter.count(some) == [len(x) for x in model.encode(some)]
    assert all(len(model.encode(w)) == 1 for w in list(counter.whole)[:500] if w)


def test_language(spark, odd, empty, docs):
    model = language.train(docs.where(~language.held_out()))
    again = language.train(docs.where(~language.held_out()).repartition(7))
    assert (model.family_weights == again.family_weights).all()  # the same rows are drawn however they are stored
    got = language.identify(docs, model).where(language.held_out()).select("lang", F.col("language.lang").alias("p")).collect()
    assert sum(r.lang == r.p for r in got) >= 0.9 * len(got) > 0
    rows = language.identify(odd, model).collect()
    for r in rows:
        assert (r.language.lang == "und") == (not any(c.isalpha() for c in r.text or ""))
        assert 0 <= r.language.score <= 1
    assert language.train(empty) is None and language.identify(empty, None).count() == 0
    assert {r.language.lang for r in language.identify(odd, None).collect()} == {"und"}
    one = language.train(odd)
    assert {r.language.lang for r in language.identify(odd, one).collect()} == {"en", "und"}


def test_personal_data(spark, odd, empty, docs):
    for df in (odd, docs):
        got = pii.find_spans(df).select("doc_id", "key", pii.spans_text("base").alias("base"), pii.spans_text("spans").alias("spans")).collect()
        assert len(got) == df.count()
        want = {(r.doc_id, r.text): brute.base_spans(r.text) for r in df.collect()}
        left = sorted(",".join(f"{k}:{s}:{e}" for k, s, e in v) for v in want.values())
        assert sorted({(r.doc_id, r.key): r.base for r in got}.values()) == left
        assert all(r.spans.startswith(r.base) for r in got)
    assert pii.find_spans(empty).count() == 0


def test_personal_data_fuzz(spark):
    rng = random.Random(9)
    alphabet = list("a1.@+- _%()\n2é") + ["4111111111111111", "1.2.3.4", "a@b.c"]
    rows = [(i, "".join(rng.choices(alphabet, k=rng.randrange(40)))) for i in range(1500)]
    got = pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r.b for r in got.select("doc_id", pii.spans_text("base").alias("b")).collect()}
    for i, t in rows:
        assert got[i] == ",".join(f"{k}:{s}:{e}" for k, s, e in brute.base_spans(t)), t


def test_disclosing_terms(spark):
    rows = [(i, f"clerk Quixby writes to who.am@i.example.com for number {i}") for i in range(4)]
    rows += [(100 + i, f"clerk somebody writes for number {i} about other things") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = pii.find_spans(df)
    text = {r.doc_id: r.text for r in pii.sanitised(df, spans).collect()}
    assert text[0] == "clerk  writes  <EMAIL> for number 0"  # only the name and "to" tell of that address
    assert text[100] == rows[4][1]


def test_disclosing_terms_of_whole_documents(spark):
    far = " ".join(f"about others {i}" for i in range(30))
    rows = [(i, f"Quixby of v1.2.3.4 {far} number {i}. {far} Quixby went. {far} mail who.am@i.example.com now") for i in range(4)]
    rows += [(100 + i, f"now {far} about number of went i mail {i}") for i in range(60)]
    rows += [(200, "Nobody knows Quixby")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    text = {r.doc_id: r.text for r in pii.sanitised(df, pii.find_spans(df)).collect()}
    for i in range(4):  # v1 touches a span; Quixby goes wherever it stands
        assert text[i] == f" of v<IP> {far} number {i}. {far}  went. {far} mail <EMAIL> now"
    assert text[100] == rows[4][1] and text[200] == rows[-1][1]


def test_disclosing_terms_against_brute_force(spark, docs):
    """On documents, and on made-up ones in which some words go with a domain or a prefix that is never the same value twice."""
    rng = random.Random(21)
    made = []
    for i in range(300):
        text = " ".join(f"w{chr(97 + rng.randrange(20))}" for _ in range(20))
        if i % 10 == 0:
            text += f" Clerk Quixby, x{i}@inner.example.org and tel+1 202-555-{1000 + i}."
        made.append((i, text + (" Somebody" if i % 3 else "")))
    for rows in (made, [r for r in texts_of(docs) if r[0] is not None]):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = pii.find_spans(df).select("doc_id", pii.spans_text("spans").alias("spans"), pii.spans_text("base").alias("base")).collect()
        want = brute.disclosing(rows, pii.SUPPORT, pii.SMOOTHING, pii.GENERALISE_AT, pii.REMOVE_AT)
        assert {r.doc_id: r.spans[len(r.base) :].lstrip(",") for r in got} == {d: ",".join(f"{k}:{s}:{e}" for k, s, e in v) for d, v in want.items()}
    assert any(brute.disclosing(made, 2, 0.25, 0.6, 0.9).values())


def test_personal_data_in_a_long_text(spark):
    """Time grows with the length: 30,000 addresses in one text of more than a million code points."""
    text = " ".join(f"user{i}@host{i}.example.com writes words of name{i}" for i in range(30_000))
    start = time.time()
    got = pii.find_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(pii.spans_text("base").alias("b")).first().b
    assert got == ",".join(f"{k}:{s}:{e}" for k, s, e in brute.base_spans(text)) and got.count("email") == 30_000
    assert time.time() - start < 60


def test_line_dedup(spark, odd, empty, docs):
    got = lines.dedup_lines(docs).collect()
    assert {r.doc_id: r.text for r in got} == brute.dedup_lines(texts_of(docs), lines.MIN_CHARS)
    rows = [(d, t) for d, t in dict(ODD[::-1]).items() if d is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in lines.dedup_lines(df).collect()} == brute.dedup_lines(rows, lines.MIN_CHARS)
    short = [(i, t) for i, t in enumerate(["abc def ghi", "abc def ghj", "a", "b", "", "xyz", "xy", "yz q", "abc de ghi\n  a  ", "long " * 9 + "x", "long " * 9 + "y"])]
    for least in (1, 3, 12):
        df = spark.createDataFrame(short, "doc_id long, text string")
        assert {r.doc_id: r.text for r in lines.dedup_lines(df, least).collect()} == brute.dedup_lines(short, least)
    assert {r.doc_id: r.text for r in lines.dedup_lines(docs, 1).collect()} == brute.dedup_lines(texts_of(docs), 1)
    assert lines.dedup_lines(odd).count() == len(ODD) and lines.dedup_lines(empty).count() == 0
    assert lines.with_lines_dropped(odd).columns == odd.columns


def test_line_dedup_with_shared_segments(spark):
    rng = random.Random(2)
    base = "".join(rng.choices("abcdefgh ", k=60)).strip() + "x"
    rows = []
    for i in range(160):  # far more lines on one segment than make pairs
        c = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            p, k = rng.randrange(1, len(c) - 1), rng.randrange(3)
            c[p : p + (k != 0)] = [] if k == 1 else [rng.choice("abz")]
        rows.append((i, "".join(c) + "\nshort"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in lines.dedup_lines(df).collect()} == brute.dedup_lines(rows, lines.MIN_CHARS)


def test_line_dedup_of_a_line_in_every_document(spark):
    rows = [(i, f"The licence of this text is the usual one.\nline number {i * i} of many others\nThe licence of this text is the usual on{'ea'[i % 2]}.") for i in range(400)]
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.dedup_lines(rows, lines.MIN_CHARS)


def test_edit_distances():
    rng = random.Random(3)
    left = ["".join(rng.choices("abé", k=rng.randrange(10))) for _ in range(1500)]
    right = [x[: rng.randrange(10)] + rng.choice(["", "a", "bb"]) + x[rng.randrange(10) :] for x in left]
    for band in (1, 2):
        assert lines.edit_distances(left, right, band).tolist() == [min(band + 1, brute.edit_distance(x, y)) for x, y in zip(left, right)]


def test_ngram_components(spark, odd, empty, docs):
    for df, n, percent in ((docs, 4, 85), (docs, 5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(df, n, percent).collect()}
        assert got == brute.ngram_components(texts_of(df), n, percent)
    got = ngram_join.ngram_components(odd).collect()
    assert len(got) == len(ODD)
    want = brute.ngram_components(ODD, 4, 85)
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got if r.doc_id is not None)
    assert ngram_join.ngram_components(empty).count() == 0


def test_ngram_large_groups(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    bases = [rng.choices(words, k=60) for _ in range(3)]
    rows = []
    for i in range(150):  # groups around texts that share a passage, with members at all distances
        text = list(rng.choice(bases))
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            text[rng.randrange(60)] = rng.choice(words)
        rows.append((i, " ".join(bases[0][:8] + text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(df).collect()}
    assert got == brute.ngram_components(rows, 4, 85)


def test_ngram_link_counts(spark, odd, docs):
    for df, rows in ((docs, texts_of(docs)), (odd, [r for r in ODD if r[0] is not None])):
        sets = [(d, brute.shingles(t, 4)) for d, t in rows]
        want = sorted((d, sum(1 for j, (_, y) in enumerate(sets) if i != j and x and y and 100 * len(x & y) >= 85 * len(x | y))) for i, (d, x) in enumerate(sets))
        got = sorted((r.doc_id, r.n_links) for r in ngram_join.link_counts(df).collect() if r.doc_id is not None)
        assert got == want
    assert ngram_join.link_counts(odd.limit(0)).count() == 0


def test_token_files(spark, odd, empty, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    for df in (odd, docs):
        got = sorted(tokenfile.roundtrip(df, path).collect(), key=lambda r: r.start)
        rows = sorted(texts_of(df), key=lambda r: (r[0] is not None, r[0]))
        start = 0
        for r, (doc_id, text) in zip(got, rows, strict=True):
            ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
            assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
            start += len(ids)
    assert tokenfile.roundtrip(empty, path).count() == 0


def test_token_shards():
    docs = [(i, np.arange(i % 40, dtype="<u4").tobytes()) for i in range(500)] + [(None, b"\1\0\0\0")]
    sink = io.BytesIO()
    assert tokenfile.write_shard(iter(docs), sink, frame_ids=300)[0] == 501
    reader = tokenfile.ShardReader(sink)
    assert len(reader.frames) > 10
    assert [x.tobytes() for _, x in reader.documents()] == [d for _, d in docs]
    opened = []
    frame = reader.frame
    reader.frame = lambda k: opened.append(k) or frame(k)
    assert [(r, x.tobytes()) for r, x in reader.documents(reader.rows_of([7, 450]))] == [(7, docs[7][1]), (450, docs[450][1])]
    assert len(opened) == 2
    damaged = bytearray(sink.getvalue())
    damaged[30] ^= 1
    with pytest.raises(ValueError):
        list(tokenfile.ShardReader(io.BytesIO(bytes(damaged))).documents())
    with pytest.raises(ValueError):
        tokenfile.ShardReader(io.BytesIO(sink.getvalue()[:-5]))


def test_mixing(spark, odd, empty, docs):
    df = docs.select("doc_id", "source", words_of("text").alias("n_tokens"))
    got = mixing.mix(df, block_docs=3).collect()
    assert len(got) == df.count() and min(r.copies for r in got) >= 1 and max(r.copies for r in got) <= 5
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    total = sum(r.n_tokens * r.copies for r in got)
    for rows in by.values():  # realised shares differ from the weights by less than a document
        share = sum(r.n_tokens * r.copies for r in rows) / total
        assert abs(share - rows[0].weight) <= max(r.n_tokens for r in rows) / total + 0.02
        order = sorted(rows, key=lambda r: (r.block, r.rank))
        extra = [r.copies for r in order if r.n_tokens]
        assert extra == sorted(extra, reverse=True)
    assert abs(sum(rows[0].weight for rows in by.values()) - 1) < 1e-6
    assert mixing.mix(empty.select("doc_id", "source", F.col("n").alias("n_tokens"))).count() == 0
    assert mixing.mix(odd.select("doc_id", "source", words_of("text").alias("n_tokens"))).count() == len(ODD)


def test_exponent(spark):
    shares = {"a": 900, "b": 60, "c": 40, "d": 0}
    df = spark.createDataFrame([(s, t, 1) for s, t in shares.items()], "source string, tokens long, docs long")
    p = np.array([0.9, 0.06, 0.04])

    def entropy(a):
        w = p**a / (p**a).sum()
        return -(w * np.log(w)).sum()

    a = mixing.bisect_exponent(df, entropy=0.5, max_epochs=1e9)
    assert abs(entropy(a) - (entropy(1) + entropy(0)) / 2) < 1e-4
    a = mixing.bisect_exponent(df, entropy=1.0, max_epochs=3.0)
    epochs = p**a / p
    assert abs(epochs.max() / epochs.min() - 3) < 1e-3


def test_mixing_against_brute_force(spark, docs):
    rows = [(r.doc_id, r.source, r.n) for r in docs.select("doc_id", "source", words_of("text").alias("n")).collect()]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    for entropy, epochs in ((0.5, 4.0), (0.9, 1.5)):
        want = brute.mixed(rows, entropy, epochs, mixing.PASSES, 7, mixing.SEED)
        got = {r.doc_id: (r.weight, r.copies) for r in mixing.mix(df, entropy, epochs, block_docs=7).collect()}
        assert {d: c for d, (_, c) in got.items()} == {d: c for d, (_, c) in want.items()}
        assert all(abs(got[d][0] - w) < 1e-6 for d, (w, _) in want.items())


def test_mixing_keeps_a_key(spark, odd):
    df = odd.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", words_of("text").alias("n_tokens"))
    got = mixing.mix(df, key="row").collect()
    assert sorted(r.row for r in got) == sorted(r.row for r in df.collect()) and min(r.copies for r in got) >= 1


def test_packing(spark, odd, empty, docs):
    df = docs.select("doc_id", "source", packing.clusters_of("text").alias("clusters"), words_of("text").alias("length"))
    want = {r.doc_id: r for r in df.collect()}
    got = packing.pack(df, capacity=700, per_source=2, shard_docs=80).collect()
    again = packing.pack(df.orderBy(F.desc("doc_id")).repartition(3), capacity=700, per_source=2, shard_docs=80).collect()
    assert sorted(got) == sorted(again)  # however the rows are stored
    bins, lengths, shards = {}, {}, {}
    for r in got:
        bins.setdefault(r.bin, []).append(r)
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
        assert r.start == 700 * r.piece
        if "full" not in r.bin:
            shards.setdefault(r.bin.split("-")[0], {})[r.doc_id] = int(r.bin.split("-")[1]), r.offset
    assert lengths == {d: max(1, r.length) for d, r in want.items()}
    for rows in bins.values():
        rows.sort(key=lambda r: r.position)
        assert [r.offset for r in rows] == [sum(x.length for x in rows[:i]) for i in range(len(rows))]
        assert sum(r.length for r in rows) <= 700
    assert len(shards) == 3
    for placed in shards.values():  # what shares a shard is packed as a search over all bins packs it
        rows = [(d, want[d].source, want[d].clusters, max(1, want[d].length)) for d in placed]
        plain = brute.packed(rows, 700, 2)
        # bins of equal residual may stand in for each other
        assert sorted(o for _, o in plain.values()) == sorted(o for _, o in placed.values())
        assert len({b for b, _ in plain.values()}) == len({b for b, _ in placed.values()})
    odd = odd.select("doc_id", "source", F.lit(None).cast("array<long>").alias("clusters"), F.col("n").alias("length"))
    assert packing.pack(odd).count() == len(ODD) and packing.pack(odd.limit(0)).count() == 0
    assert packing.pack(odd.limit(1).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(50)))), shard_docs=5).count() == 50


def test_clusters_of_near_copies(spark):
    rng = random.Random(12)
    base = [f"w{rng.randrange(500)}" for _ in range(300)]
    near = base[:150] + ["other"] + base[151:]
    rows = [(0, " ".join(base)), (1, " ".join(near)), (2, " ".join(f"v{rng.randrange(500)}" for _ in range(300))), (3, None), (4, ""), (5, " ".join(base).upper())]
    got = {r.id: r.c for r in spark.createDataFrame(rows, "id int, text string").select("id", packing.clusters_of("text").alias("c")).collect()}
    assert set(got[0]) & set(got[1]) and not set(got[0]) & set(got[2]) and got[3] == [] and got[0] == got[5] and len(got[4]) == 1


def test_clashing_columns(spark, odd):
    """A column that is named like a new one is replaced; all others stay."""
    df = odd.withColumns({c: F.lit(7) for c in ("features", "media", "n_tokens", "language")})
    got = media.media_columns(df)
    assert sorted(got.columns) == sorted(df.columns) and all(r.features.ok and r.n_tokens == 7 for r in got.collect())
    assert all(r.n_tokens != 7 or r.text for r in tokens.token_counts(df, public_tokenizers.path("piece_bpe_32k.model")).collect())
    assert {r.language.lang for r in language.identify(df, None).collect()} == {"und"}


def test_cosine_hash():
    """Against the cosine transform by its definition, of an image that needs no scaling."""
    rng = np.random.default_rng(3)
    for _ in range(5):
        image = rng.integers(0, 256, (32, 32), np.uint8)
        at = np.arange(32)
        low = [[sum(image[y, x] * np.cos(np.pi * (y + 0.5) * u / 32) * np.cos(np.pi * (x + 0.5) * v / 32) for y in at for x in at) for v in range(8)] for u in range(8)]
        low = np.array(low).ravel()
        assert media.cosine_hash(image) == np.packbits(low > np.median(low[1:])).tobytes()
    smooth = np.add.outer(np.arange(64), np.arange(64)).astype(np.uint8)
    other = np.packbits(np.unpackbits(np.frombuffer(media.cosine_hash(smooth), np.uint8)) ^ np.unpackbits(np.frombuffer(media.cosine_hash(smooth + (smooth % 2)), np.uint8)))
    assert np.unpackbits(other).sum() <= 8  # a little noise changes few bits


def test_best_fit():
    """Each piece is in the compatible bin of least residual, as a search over all bins finds it."""
    rng = random.Random(8)
    bins, plain = packing.Bins(100, 2), []
    for _ in range(400):
        length, source, cluster = rng.randrange(1, 60), rng.randrange(4), rng.randrange(12)
        fits = [b for b in plain if b["left"] >= length and cluster not in b["clusters"] and b["sources"].count(source) < 2]
        b, _, _ = bins.place(length, source, 1 << cluster)
        if fits:
            assert plain[b] in fits and plain[b]["left"] == min(x["left"] for x in fits)
        else:
            assert b == len(plain)
            plain.append({"left": 100, "clusters": set(), "sources": []})
        plain[b]["left"] -= length
        plain[b]["clusters"].add(cluster)
        plain[b]["sources"].append(source)


def test_fingerprints(spark, odd, empty, docs):
    for df in (docs, odd.where("doc_id is not null").dropDuplicates(["doc_id"])):
        rows = sorted(texts_of(df), reverse=True)
        following = {d: rows[(i + 1) % len(rows)][1] or "" for i, (d, _) in enumerate(rows)}
        got = {r.doc_id: r for r in fingerprint.edited_pairs(df).collect()}
        assert len(got) == len(rows)
        for d, t in rows:
            t = t or ""
            k = len(t) // 3
            edited = t[: len(t) - k] + following[d][:k]
            assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), d
            assert (got[d].fingerprint == got[d].edited_fingerprint) or edited != t
    assert fingerprint.edited_pairs(empty).count() == 0
    assert fingerprint.edited_pairs(odd).count() == len(ODD)


def test_fingerprint_buckets(spark, docs, monkeypatch):
    whole = {r.doc_id: r for r in fingerprint.edited_pairs(docs).collect()}
    monkeypatch.setattr(fingerprint, "BUCKET_CHARS", 20_000)
    monkeypatch.setattr(fingerprint, "QUANTILES", 8)
    assert {r.doc_id: r for r in fingerprint.edited_pairs(docs).collect()} == whole


def test_fingerprint_likeness(spark):
    """At the number of samples that production uses: mean error and bias against the generalised Jaccard similarity."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    rows, want = [], []
    for i in range(160):
        x = rng.choices(words, k=80)
        y = x[: rng.randrange(81)] + rng.choices(words, k=40)
        rows.append((i, " ".join(x), " ".join(y)))
        s, t = ({w: 1 + np.log(z.count(w)) for w in z} for z in (x, y))
        want.append(sum(min(s.get(w, 0), t.get(w, 0)) for w in {*s, *t}) / sum(max(s.get(w, 0), t.get(w, 0)) for w in {*s, *t}))
    df = spark.createDataFrame(rows, "id long, text string, edited string")
    n, want = fingerprint.SAMPLES, np.array(want)
    got = fingerprint._signatures(df, ["id"], n).select("id", F.expr(fingerprint.likeness("own", "edited", n)).alias("x"))
    off = np.array([r.x for r in sorted(got.collect())]) - want
    # the mean of |off| that a binomial share has, sqrt(2 / pi) of its standard error
    assert n >= 48 and np.abs(off).mean() < 1.2 * (0.798 * np.sqrt(want * (1 - want) / n)).mean() and abs(off.mean()) < 0.02


def test_fingerprint_likeness_of_the_query(spark, docs):
    rows = sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()), reverse=True)
    weights = lambda t: {w: 1 + np.log(n) for w, n in Counter(t.lower().split() or [""]).items()}

    def likeness(x, y):
        s, t = weights(x), weights(y)
        return sum(min(s[w], t.get(w, 0)) for w in s) / sum(max(s.get(w, 0), t.get(w, 0)) for w in {*s, *t})

    got, off = {r.doc_id: r for r in queries.op10_fingerprints(spark, SF).collect()}, []
    for i, (d, t) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        k = len(t) // 3
        off += [got[d].near_edited - likeness(t, t[: len(t) - k] + following[:k]), got[d].near_next - likeness(t, following)]
    assert np.abs(off).mean() < 0.05 and np.abs(off).max() < 0.3 and abs(np.mean(off)) < 0.01


def test_personal_data_query(spark, docs):
    want = {r.doc_id: brute.base_spans(r.text) for r in docs.collect()}
    for r in queries.op4_pii(spark, SF).collect():
        kinds = [k for k, _, _ in want[r.doc_id]]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [kinds.count(k) for k in ("email", "ip", "card", "phone")]
        assert r.base_sha256 == brute.spans_sha(want[r.doc_id])


def test_queries_return_their_columns(spark):
    want = {
        "op1_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
        "op2_tokens": "doc_id n_bytes n_tokens over_limit",
        "op3_language": "doc_id held_out lang_pred score",
        "op4_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
        "op6_ngram_join": "doc_id n_shingles component_id",
        "op7_token_files": "doc_id start n_tokens ids_crc32",
        "op10_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    }
    for name, columns in want.items():
        df = queries.QUERIES[name](spark, SF)
        assert df.columns == columns.split() and df.count() == 200


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, code string, integers int")


def _by_hand(rows, parts, entries, rounds):
    """Plain k-means over the integers, as the contract states it: vec_id -> (code, error), and the books."""
    kept = sorted(((v[0] is None, v[0] or 0, [math.floor(1024 * x) for x in v[1]]), v[0], [math.floor(1024 * x) for x in v[1]]) for v in rows)
    vectors = [v for _, _, v in kept]
    width = len(vectors[0]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for v in vectors[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for v in vectors:
                groups.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            for i, g in groups.items():
                books[p][i] = [sum(c) // len(c) for c in zip(*g)]
    found = [(i, [near(cut(v, p), books[p]) for p in range(parts)]) for _, i, v in kept]
    return sorted(("".join(f"{i:02x}" for _, i in n), sum(d for d, _ in n)) for _, n in found), books


def test_vector_codes_against_plain_rounds(spark):
    rng = random.Random(4)
    value = lambda: rng.choice([rng.uniform(-1, 1), rng.randint(-2, 2) / 1024, -0.0005])  # noqa: E731  many ties
    rows = [(i // 2 if i % 9 else None, [value() for _ in range(8)], i % 3 or None, "x", 1) for i in range(120)]
    rows += [(500, rows[0][1], 1, "x", 1)] * 4
    odd = [(1, None, 1, "x", 1), (2, [], 1, "x", 1), (3, [1.0] * 7 + [None], 1, "x", 1), (4, [1.0] * 7 + [math.nan], 1, "x", 1), (5, [1.0] * 7 + [math.inf], 2, "x", 1), (6, [1.0] * 12, 2, "x", 1), (7, [1.0] * 7, 2, "x", 1)]
    for entries in (3, 40, 256):
        coded, books = vectors.compress(_vectors(spark, rows + odd), entries=entries, parts=4)
        out = vectors.with_group_error(coded, "label", "label_error").collect()
        want, by_hand = _by_hand(rows, 4, entries, 4)
        assert sorted((r.code, r.error) for r in out) == want
        assert [b.tolist() for b in books.books] == by_hand
        totals = Counter()
        for r in out:
            totals[r.label] += r.error
        assert all(r.label_error == totals[r.label] and r.integers == 1 for r in out)
    empty, books = vectors.compress(_vectors(spark, odd[:5]))
    assert vectors.with_group_error(empty, "label", "label_error").count() == 0 and books.books == []
    with pytest.raises(Exception, match="or more in size"):
        vectors.compress(_vectors(spark, [(1, [1e9] * 4, 1, "x", 1)]))[0].count()


def test_tree_keeps_lower_index_on_ties():
    rng = np.random.default_rng(5)
    for width, spread in ((1, 3), (2, 4), (16, 2), (3, 2**22)):
        for k in (1, 2, 17, 256):
            book, points = rng.integers(-spread, spread, (k, width)), rng.integers(-spread, spread, (300, width))
            found, away = vectors.nearest(vectors.grow(book), book, points)
            plain = ((points[:, None, :] - book[None]) ** 2).sum(axis=2)
            assert (found == plain.argmin(axis=1)).all() and (away == plain.min(axis=1)).all()


def test_spelling_variants_by_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    for trial, letters in enumerate(("ab", "abcéÿ", "abcdefgh")):
        words = {"".join(rng.choice(letters) for _ in range(rng.randint(6, 8))) for _ in range(90)} | {"a" * n for n in range(6, 20)} | {"longword" * 300, "longword" * 299 + "longwird"}
        counted = {w: rng.choice([5, 7, 25, 125, 700]) for w in words}
        want = {}
        for w, n in counted.items():
            near = [(-counted[v], v) for v in words if v != w and brute.within_one_edit(w, v)]
            best = min(near, default=(0, None))
            want[w] = (n, len(near), best[1] if -best[0] >= 5 * n else None, -best[0] if -best[0] >= 5 * n else None)
        df = spark.createDataFrame(list(counted.items()), "word string, n long")
        for big, rows_per_task in ((10_000, 100_000), (4, 40)):
            got = spelling.variants(df, big=big, rows_per_task=rows_per_task)
            rooted = spelling.with_roots(got).collect()
            assert {r.word: (r.n, r.n_near, r.form, r.form_n) for r in rooted} == want
            forms = {w: f for w, (_, _, f, _) in want.items()}
            for r in rooted:
                at = r.word
                while forms[at]:
                    at = forms[at]
                assert r.root == at


def test_spelling_vocabulary(spark, odd, empty):
    rows = [(d, t) for d in range(30) for t in ["Häuser HÄUSER xÿyzabc Foo_barbaz abcdefghij", None, "", "q" * 7000]] + [(None, "abcdefghij")]
    want = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 3 == 0 else run] += 1
    want = {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}
    got = spelling.vocabulary(spark.createDataFrame(rows, "doc_id long, text string"), garbled=3)
    assert dict(map(tuple, got.collect())) == want
    assert spelling.with_roots(spelling.variants(spelling.vocabulary(empty))).count() == 0
    assert spelling.with_roots(spelling.variants(spelling.vocabulary(odd, least_count=1))).count() > 0


def test_spelling_query_by_brute_force(spark, docs, tmp_path):
    """The query on a part of the table: the same as counting and comparing all words with each other."""
    some = docs.orderBy("doc_id").limit(160)
    some.write.parquet(str(tmp_path / "documents.parquet"))
    counts = Counter()
    for d, t in texts_of(some):
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{d}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in counts if v != w and abs(len(v) - len(w)) <= 1 and brute.within_one_edit(w, v)] for w in counts}
    form = {w: (min((-counts[v], v) for v in vs) if vs else None) for w, vs in near.items()}
    form = {w: f[1] if f and -f[0] >= 5 * counts[w] else None for w, f in form.items()}
    got = {r.word: r for r in queries.op11_spelling(spark, str(tmp_path)).collect()}
    assert len(counts) > 200 and got.keys() == counts.keys()
    for w, r in got.items():
        root = w
        while form[root]:
            root = form[root]
        assert (r.n, r.n_near, r.form, r.root, r.form_n) == (counts[w], len(near[w]), form[w], root, counts[form[w]] if form[w] else None)


def _maximal(scores):
    """Segments by the recursive definition: the best one (the first, the shortest), then those on both sides of it."""
    if not scores:
        return []
    best = max(((sum(scores[i:j]), -i, -j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)))
    total, i, j = best[0], -best[1], -best[2]
    if total <= 0:
        return []
    return _maximal(scores[:i]) + [(i, j, total)] + [(a + j, b + j, s) for a, b, s in _maximal(scores[j:])]


def test_maximal_segments():
    rng = random.Random(8)
    for _ in range(300):
        scores = [rng.choice([-3, -2, -1, 1, 2, 5]) + rng.random() for _ in range(rng.randint(0, 14))]
        got = toxicity.segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in _maximal(scores)]
        assert all(s == pytest.approx(sum(scores[a:b])) for a, b, s in got)
    many = [5.0, -4.0] * 100_000
    start = time.time()
    assert toxicity.segments(many) == [(0, 199_999, pytest.approx(100_004.0))] and time.time() - start < 5


def _toxic_rows(n=400):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 7)))
    common = [word() for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(common) for _ in range(rng.randint(5, 120))]
        toxic = i % 8 == 0
        if toxic:
            at = rng.randint(0, len(text))
            text[at:at] = [rng.choice(["Vilewort", "hateling", "scumbane"]) for _ in range(rng.randint(2, 5))]
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity(spark, odd):
    rows, labels = _toxic_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels + [(None, 1), (3, None), (5, 0), (99999, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, known)
    assert {"vilewort", "hateling", "scumbane"} <= {w for w, s in model.weights.items() if s > 0}
    got = {r.doc_id: r.toxicity for r in toxicity.toxicity(docs.withColumn("score", F.lit(1)).withColumn("toxicity", F.lit(2)), model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 50 and all((got[i].score >= 0.5) == (i % 8 == 0) for i in held)
    for i, text in rows:
        for p in got[i].passages:
            assert set(text.lower()[p.start : p.end].split()) & {"vilewort", "hateling", "scumbane"}
    bad = [p for i in got if i % 8 == 0 for p in got[i].passages]
    assert len(bad) > 40 and all(p.expected <= toxicity.SIGNIFICANT for p in bad)
    scored = toxicity.toxicity(odd, model).select("doc_id", "n", "toxicity.score").collect()
    assert len(scored) == len(ODD) and all(0 <= r.score < 0.5 for r in scored)
    few = toxicity.train(docs, known, most=100)  # a bounded sample
    assert few.weights.keys() & {"vilewort", "hateling", "scumbane"}


def test_toxicity_without_labels(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(4, 1), (6, 1)], "doc_id long, toxic int")
    for labels in (none, one):
        model = toxicity.train(odd, labels)
        assert all(r.toxicity.score == 0 and not r.toxicity.passages for r in toxicity.toxicity(odd, model).collect())
        assert toxicity.toxicity(empty, model).count() == 0


def test_toxicity_does_not_look_at_held_out_labels(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.train(docs, x) for x in (labels, turned))
    assert a == b


def test_toxicity_held_out_accuracy(spark):
    sf = SF.replace("sf0.001", "sf0.1")
    got = queries.op13_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    n = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] >= 0.8 * (n[1, 1] + n[1, 0]) and n.get((0, 1), 0) <= 0.01 * n[0, 0]


def test_vector_codes_against_sql(spark):
    from tests.parity import connect, differences

    assert not differences(spark, connect(SF), "op12", queries.op12_vector_codes, queries.ORACLE_SQL["op12_vector_codes"], SF)


def test_png_reader_only_raises_value_errors(spark):
    """Heads of any length and size, images without samples, and whatever is packed in them, under right checksums."""
    rng, good = random.Random(14), media.encode_png(media.payload_of("some text of an image"))
    chunk, ihdr = media._chunk, lambda *x: media.struct.pack(">IIBBBBB", *x)
    idat = chunk(b"IDAT", zlib.compress(bytes(65)))
    odd = [
        media.SIGNATURE + chunk(b"IHDR", head) + idat + chunk(b"IEND", b"")
        for head in (b"", b"x" * 12, b"x" * 14, ihdr(0, 1, 8, 0, 0, 0, 0), ihdr(64, 0, 8, 0, 0, 0, 0), ihdr(2**32 - 1, 2**32 - 1, 8, 6, 0, 0, 0), ihdr(64, 1, 16, 0, 0, 0, 0))
    ]
    head = chunk(b"IHDR", ihdr(64, 1, 8, 0, 0, 0, 0))
    odd += [media.SIGNATURE + head + head + idat + chunk(b"IEND", b""), media.SIGNATURE + head + chunk(b"IEND", b"")]
    odd += [media.SIGNATURE + head + chunk(b"IDAT", zlib.compress(bytes(10_000_000))) + chunk(b"IEND", b""), media.SIGNATURE + head + chunk(b"IDAT", zlib.compress(b"\7" + bytes(64))) + chunk(b"IEND", b"")]
    for _ in range(500):
        data = bytearray(good)
        for _ in range(rng.randint(1, 6)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        odd.append(bytes(data[: rng.choice([len(data), rng.randrange(len(data))])]))
        body = bytes(rng.randrange(256) for _ in range(rng.randint(0, 20)))
        odd.append(media.SIGNATURE + chunk(b"IHDR", body) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b""))
    for data in odd:
        try:
            assert media.decode_png(data).size
        except ValueError:
            pass
    rows = spark.createDataFrame([(x,) for x in odd[:12] + [good, None]], "media binary").select(media.features_of("media").alias("f")).collect()
    assert [r.f.ok for r in rows] == [False] * 11 + [rows[11].f.ok, True, False]


def test_more_labels_than_languages(spark):
    rows = [(i, f"{w} text of words {i}", lang) for i, (w, lang) in enumerate([("some", "aa")] * 5 + [("other", "bb")] * 4 + [("odd", f"x{i}") for i in range(30)])]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_languages=3)
    assert sorted(g for gs in model.languages.values() for g in gs) == ["aa", "bb", "x0"]


def test_pii_of_many_repeated_entities(spark):
    """Two long texts share 5,000 addresses of different hosts and 5,000 words; entities in the same texts go on as one, so that no product is made."""
    words = " ".join(f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100 % 10]}{'efghijklmn'[i // 1000]}word" for i in range(5000))
    mails = " ".join(f"u{i}@h{i}.org" for i in range(5000))
    rows = [(0, f"{words} {mails}"), (1, f"{mails} {words}")] + [(i, f"plain text of its own {i}") for i in range(2, 60)]
    start = time.time()
    got = {r.doc_id: r for r in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == 60 and len(got[0].base) == 5000
    assert all(len(got[d].spans) - len(got[d].base) >= 5000 for d in (0, 1)) and len(got[5].spans) == 0
    assert time.time() - start < 120


def test_conflicts_are_near_copies(spark):
    """On a whole table, against the similarity of all pairs: near copies share a cluster, and what shares one is seldom unlike."""
    rows = spark.read.parquet(SF.replace("sf0.001", "sf0.01") + "/documents.parquet").where("text is not null").select("doc_id", "text", packing.clusters_of("text").alias("c")).collect()
    sets = [brute.shingles(r.text, 5) for r in rows]
    near = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    shared, clustered = Counter(), set()
    for key in (sets, [set(r.c) for r in rows]):
        places = {}
        for i, own in enumerate(key):
            for g in own if sets[i] else ():
                places.setdefault(g, []).append(i)
        for v in places.values():
            if len(v) < 400:
                for a, i in enumerate(v):
                    (shared if key is sets else clustered).update((i, j) for j in v[a + 1 :])
    alike = {p for p in shared if near(*p) >= 0.8}
    assert len(alike) > 50 and len(alike & clustered) >= 0.97 * len(alike)
    assert sum(near(*p) >= 0.5 for p in clustered) >= 0.9 * len(clustered)


def _model_tokens(docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return {d: len(model.encode(t or "")) for d, t in texts_of(docs)}


def test_line_dedup_query(spark, docs):
    got = {r.doc_id: r for r in queries.op5_line_dedup(spark, SF).collect()}
    want = brute.dedup_lines(texts_of(docs), lines.MIN_CHARS)
    assert got.keys() == want.keys()
    for d, r in got.items():
        assert r.text == want[d] and r.kept_sha256 == (hashlib.sha256(r.text.encode()).hexdigest() if r.text is not None else None)
        assert r.n_kept <= r.n_lines


def test_mixing_query(spark, docs):
    tokens_of = _model_tokens(docs)
    rows = [(r.doc_id, r.source, tokens_of[r.doc_id]) for r in docs.collect()]
    want = brute.mixed(rows, mixing.ENTROPY, mixing.MAX_EPOCHS, mixing.PASSES, mixing.BLOCK_DOCS, mixing.SEED)
    got = {r.doc_id: r for r in queries.op8_mixing(spark, SF).collect()}
    assert {d: (r.n_tokens, r.copies) for d, r in got.items()} == {d: (tokens_of[d], want[d][1]) for d in tokens_of}


def test_packing_query(spark, docs):
    tokens_of, bins, lengths = _model_tokens(docs), {}, Counter()
    for r in queries.op9_packing(spark, SF).collect():
        bins.setdefault(r.bin, []).append(r)
        lengths[r.doc_id] += r.length
    assert lengths == {d: max(1, n) for d, n in tokens_of.items()}
    sets = {d: brute.shingles(t, packing.WORDS) for d, t in texts_of(docs) if t is not None}
    of_source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    for rows in bins.values():
        assert sum(r.length for r in rows) <= packing.CAPACITY and max(Counter(of_source[r.doc_id] for r in rows).values()) <= packing.PER_SOURCE
        ids = [r.doc_id for r in rows if r.doc_id in sets and sets[r.doc_id]]
        assert all(len(sets[a] & sets[b]) < 0.95 * len(sets[a] | sets[b]) for i, a in enumerate(ids) for b in ids[i + 1 :])
