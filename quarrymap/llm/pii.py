"""Personal data: pattern spans, then information-theoretic sanitisation of the words that give them away.

Base spans (email, ip, card, phone) come from patterns, leftmost and non-overlapping for each kind. An occurrence is then
a protected entity twice: by its kind and normalised value, and by what it shares with others (the domain of an address, the
first parts of an ip, the issuer of a card, the first digits of a phone). For each word that a text with the entity has anywhere
outside base spans, counts of rows estimate how much of the entity's information content the word discloses:
pmi(entity; word) / ic(entity), with pmi = ln(n * n_both / (n_entity * (n_word + 1/4))) and ic = ln(n / n_entity). Words at
`generalise_at` or above are generalised (kind `term`), at `remove_at` or above removed (kind `removed`), wherever they stand
in the texts that hold that entity. A word needs `support` different texts that hold it and the entity, so that an entity
seen once proves nothing by itself, only through what it shares. Words are compared by a hash of 64 bits of their lower case,
texts by one of theirs.

Only DataFrame functions. Null and empty texts have no spans. Repeated rows count each and get equal results. Texts of any
length: patterns take linear time, and the words of texts with base spans are rows, not arrays. Offsets are in code points, ends
exclusive. Documents without base spans never change. Other columns are not returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymap.llm.common import stored

KINDS = ["email", "ip", "card", "phone", "term", "removed"]
SUPPORT, SMOOTHING, GENERALISE_AT, REMOVE_AT = 2, 0.25, 0.6, 0.9

# The patterns match what the plain ones do, without repeated scans of long runs: a match starts where its run starts or
# where the match before it ended (\G), and repeats are possessive where what follows can't be part of them.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
WORD = r"\p{L}[\p{L}\p{N}_'’-]*+"


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


BLOCK = 256


def _zipped(text: str, pattern: str) -> str:
    """SQL for array<struct<g, v>> of the two groups of each match."""
    one, two = (f"regexp_extract_all({text}, {_quoted(pattern)}, {i})" for i in (1, 2))
    return f"zip_with({one}, {two}, (g, v) -> named_struct('g', g, 'v', v))"


def located(text: str, pattern: str) -> str:
    """SQL for array<struct<s, e, v>> of the matches of pattern, from what stands before each match and the match itself: places
    are sums of lengths. The sums go on in blocks, so that no long array is copied for each match: linear in the text."""
    both = rf"(?s)\G(.*?)({pattern})"
    zipped = _zipped(text, both)
    span = "struct<s:int,e:int,v:string>"
    inner = (
        f"aggregate(slice(ms, k * {BLOCK} + 1, {BLOCK}), named_struct('at', a.at, 'out', cast(array() as array<{span}>)), (b, m) -> named_struct("
        "'at', b.at + length(m.g) + length(m.v), 'out', concat(b.out, array(named_struct('s', b.at + length(m.g), 'e', b.at + length(m.g) + length(m.v), 'v', m.v)))))"
    )
    outer = (
        f"aggregate(sequence(0, size(ms) div {BLOCK}), named_struct('at', 0, 'out', cast(array() as array<array<{span}>>)), (a, k) -> "
        f"element_at(transform(array({inner}), r -> named_struct('at', r.at, 'out', concat(a.out, array(r.out)))), 1), a -> flatten(a.out))"
    )
    return f"element_at(transform(array({zipped}), ms -> {outer}), 1)"


def _valid() -> list[str]:
    digits = "regexp_replace(x.v, '[^0-9]', '')"
    return [
        "true",
        f"x.v rlike {_quoted(f'^{OCTET}(?:[.]{OCTET}){{3}}$')}",
        f"length({digits}) <= 19 and luhn_check({digits})",
        f"length({digits}) between 9 and 15",
    ]


def _base_spans(text: str) -> str:
    """SQL for array<struct<kind, s, e, v>> of all base spans by kind, then start; v normalised."""
    needs = [f"{text} rlike {_quoted(p)}" for p in (EMAIL, IP, CARD, PHONE)]
    needs[0], needs[3] = f"contains({text}, '@') and {needs[0]}", f"contains({text}, '+') and {needs[3]}"
    none = "cast(array() as array<struct<s:int,e:int,v:string>>)"
    parts = []
    for kind, (pattern, need, valid) in enumerate(zip((EMAIL, IP, CARD, PHONE), needs, _valid())):
        value = "lower(x.v)" if kind == 0 else "x.v" if kind == 1 else "regexp_replace(x.v, '[^0-9]', '')"
        found = f"if({need}, {located(text, pattern)}, {none})"
        parts.append(
            f"transform(filter({found}, x -> {valid}), x -> named_struct('kind', {kind}, 's', x.s, 'e', x.e, 'v', {value}))"
        )
    return f"concat({', '.join(parts)})"


def _words(text: str) -> str:
    """SQL for the hashes of all words, in order."""
    return f"transform(regexp_extract_all({text}, {_quoted(WORD)}, 0), w -> xxhash64(lower(w)))"


def _groups(spans: str) -> str:
    """SQL for the hashes of what the values of spans (kind, v) have in common with others: the domain of an address, the first
    two parts of an ip, the issuer of a card, the first five digits of a phone."""
    common = (
        "case x.kind when 0 then substring_index(x.v, '@', -1) when 1 then substring_index(x.v, '.', 2) "
        "when 2 then substring(x.v, 1, 6) else substring(x.v, 1, 5) end"
    )
    return f"transform({spans}, x -> xxhash64(x.kind, 'group', {common}))"


def _placed_words(texts: DataFrame) -> DataFrame:
    """(same, term, s, e, touches) of the words of (same, text, base): a row for each occurrence, its place, and whether it has
    code points in common with a base span."""
    pairs = _zipped("text", rf"\G(\P{{L}}*+)({WORD})")
    words = texts.select("same", F.posexplode(F.expr(pairs)).alias("pos", "x"))
    words = words.select("same", "pos", F.length("x.g").alias("g"), F.length("x.v").alias("n"), F.xxhash64(F.lower("x.v")).alias("term"))
    order = Window.partitionBy("same").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    words = words.withColumn("e", F.sum(F.col("g") + F.col("n")).over(order).cast("int"))
    words = words.select("same", F.col("e").alias("at"), F.lit(0).alias("span"), "term", (F.col("e") - F.col("n")).alias("s"), "e")
    spans = texts.select("same", F.explode("base").alias("b"))
    spans = spans.select("same", F.col("b.s").alias("at"), F.lit(1).alias("span"), F.lit(None).cast("long").alias("term"), "b.s", "b.e")
    # of the spans that begin before a word ends, the one that reaches furthest
    before = Window.partitionBy("same").orderBy("at", "span").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = words.unionByName(spans).withColumn("reach", F.max(F.when(F.col("span") == 1, F.col("e"))).over(before))
    return both.where("span = 0").select("same", "term", "s", "e", F.coalesce(F.col("reach") > F.col("s"), F.lit(False)).alias("touches"))


def find_spans(
    df: DataFrame,
    support: int = SUPPORT,
    generalise_at: float = GENERALISE_AT,
    remove_at: float = REMOVE_AT,
) -> DataFrame:
    """(doc_id, key, base, spans) of the whole texts of (doc_id, text); base and spans are array<struct<kind, s, e>>, kind
    a place in KINDS; key is xxhash64(doc_id, text)."""
    docs = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = float(max(docs.count(), 1))
    found = docs.withColumn("base", F.expr(_base_spans("text")))
    found = stored(
        found.select(
            "doc_id",
            F.xxhash64("doc_id", "text").alias("key"),
            F.when(F.size("base") > 0, F.xxhash64("text")).alias("same"),
            F.expr("transform(base, b -> named_struct('kind', b.kind, 's', b.s, 'e', b.e))").alias("base"),
            F.expr(f"array_distinct(concat(transform(base, b -> xxhash64(b.kind, b.v)), {_groups('base')}))").alias("entities"),
            F.when(F.size("base") > 0, F.col("text")).alias("text"),
        ),
        "spans",
    )
    # each text with base spans once, with the number of rows that have it
    held = found.where("same is not null")
    rows = held.groupBy("same").agg(F.count("*").alias("c"))
    texts = held.select("same", "text", "base", "entities").dropDuplicates(["same"])
    words = stored(_placed_words(texts.select("same", "text", "base")), "words")
    entities = stored(texts.select("same", F.explode("entities").alias("entity")).join(rows, "same"), "entities")
    terms = words.groupBy("same", "term").agg(F.min("touches").alias("only"))
    # rows that have a word outside base spans: those that have it at all less those that have it only inside
    all_words = docs.select(F.explode(F.expr(f"array_distinct({_words('text')})")).alias("term"), F.lit(1).cast("long").alias("c"))
    inside = terms.where("only").join(rows, "same").select("term", (-F.col("c")).alias("c"))
    counts = all_words.unionByName(inside).groupBy("term").agg(F.sum("c").alias("n_term")).where(F.col("n_term") >= support)
    free = terms.where("not only").select("same", "term").join(counts, "term")
    # entities that are in the same texts are told by the same words: they go on as one
    place = [F.sum(x.cast("decimal(38,0)")) for x in (F.col("same"), F.xxhash64("same"))]
    known = entities.groupBy("entity").agg(F.sum("c").alias("n_entity"), F.count("*").alias("texts"), F.xxhash64(*place, F.count("*")).alias("twins"))
    known = known.where((F.col("texts") >= support) & (F.col("n_entity") < n)).select("entity", "n_entity", "twins")
    groups = entities.join(known, "entity").select("same", "c", F.col("twins").alias("entity"), "n_entity").distinct()
    # no more rows have both than have either: pairs that could not disclose even so are never made
    most = F.least("n_entity", "n_term")
    could = F.log(F.lit(n) * most / (F.col("n_entity") * (F.col("n_term") + SMOOTHING))) >= generalise_at * F.log(F.lit(n) / F.col("n_entity")) - 1e-9
    pairs = stored(groups.join(free, "same").where(could).select("same", "entity", "term", "c", "n_entity", "n_term"), "pairs")
    both = pairs.groupBy("entity", "term").agg(
        F.count("*").alias("texts"), F.sum("c").alias("n_both"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term")
    )
    scored = both.where(F.col("texts") >= support)
    pmi = F.log(F.lit(n) * F.col("n_both") / (F.col("n_entity") * (F.col("n_term") + SMOOTHING)))
    told = pmi / F.log(F.lit(n) / F.col("n_entity"))
    kind = F.when(told >= remove_at, 5).when(told >= generalise_at, 4)
    scored = stored(scored.select("entity", "term", kind.alias("kind")).where("kind is not null"), "disclosing")
    told = pairs.join(scored, ["entity", "term"]).groupBy("same", "term").agg(F.max("kind").alias("kind"))
    added = words.where("not touches").join(told, ["same", "term"]).groupBy("same")
    added = added.agg(F.array_sort(F.collect_list(F.struct("kind", "s", "e"))).alias("added"))
    none = F.expr("cast(array() as array<struct<kind:int,s:int,e:int>>)")
    out = held.select("doc_id", "key", "base", "same").join(added, "same", "left")
    out = out.select("doc_id", "key", "base", F.concat("base", F.coalesce("added", none)).alias("spans"))
    # documents without base spans meet no words: they aren't joined
    return found.where("same is null").select("doc_id", "key", "base", F.col("base").alias("spans")).unionByName(out)


def spans_text(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat(element_at({names}, x.kind + 1), ':', x.s, ':', x.e)), ',')")


def sanitised(df: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, text) with each span replaced by its kind in angle brackets, removed words by nothing. Of overlapping spans
    the first (then the longer) is replaced and those that it touches are passed over."""
    docs = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    by_key = spans.select("key", "spans").dropDuplicates(["key"])
    labels = "array(" + ", ".join("''" if k == "removed" else f"'<{k.upper()}>'" for k in KINDS) + ")"
    order = "array_sort(transform(coalesce(spans, array()), x -> named_struct('s', x.s, 'less', -x.e, 'kind', x.kind)))"
    fold = (
        f"aggregate({order}, named_struct('at', 0, 'out', ''), (a, x) -> if(x.s < a.at, a, named_struct('at', -x.less, "
        f"'out', concat(a.out, substring(text, a.at + 1, x.s - a.at), element_at({labels}, x.kind + 1)))), "
        "a -> concat(a.out, substring(text, a.at + 1)))"
    )
    return docs.join(by_key, "key", "left").select("doc_id", F.expr(fold).alias("text"))
