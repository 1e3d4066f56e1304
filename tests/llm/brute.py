"""Plain versions of what the operators compute, for small inputs."""

import hashlib
import re


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def ngram_components(rows, n, percent):
    sets = {d: shingles(t, n) for d, t in rows if d is not None}
    ids = sorted(sets)
    links = [
        (a, b)
        for i, a in enumerate(ids)
        for b in ids[i + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    return {d: (len(sets[d]), c) for d, c in components(ids, links).items()}


def edit_distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        new = [i]
        for j, b in enumerate(y, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return row[-1]


def within_one_edit(x, y):
    """Of two different texts."""
    if len(x) > len(y):
        x, y = y, x
    i = next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), len(x))
    return len(y) - len(x) <= 1 and x[i + (len(x) == len(y)) :] == y[i + 1 :]


def dedup_lines(rows, min_chars):
    """doc -> kept text, of (doc_id, text) without repeated ids."""
    places = [(d, i, x.strip(" ")) for d, t in sorted(rows) if t is not None for i, x in enumerate(t.split("\n"))]
    texts = sorted({x for _, _, x in places if x})
    links = [
        (a, b)
        for i, a in enumerate(texts)
        for b in texts[i + 1 :]
        if min(len(a), len(b)) >= min_chars and within_one_edit(a, b)
    ]
    of, first = components(texts, links), {}
    for d, i, x in places:
        if x:
            first.setdefault(of[x], (d, i))
    kept = set(first.values())
    return {
        d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) in kept or not x.strip(" "))
        for d, t in rows
    }


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text):
    text = text or ""
    out = []
    digits = lambda s: re.sub("[^0-9]", "", s)
    for kind, pattern, ok in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 13 <= len(digits(v)) <= 19 and luhn(digits(v))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(digits(v)) <= 15),
    ):
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if ok(m[0])]
    return out


def spans_sha(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def _hash(*parts):
    """Hash of numbers and texts as the functions in SQL chain it: the result of one part is the seed of the next."""
    import struct

    import xxhash

    seed = 42
    for p in parts:
        data = p.encode() if isinstance(p, str) else struct.pack("<i" if isinstance(p, Small) else "<q", p)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >> 63 else seed


class Small(int):
    """A number of four bytes."""


def mixed(rows, entropy, max_epochs, passes, block_docs, seed):
    """doc_id -> (weight, copies) of (doc_id, source, tokens) without repeated ids, nulls or empty sources."""
    import math
    from collections import Counter

    tokens, docs = Counter(), Counter()
    for _, s, n in rows:
        tokens[s] += n
        docs[s] += 1
    total = sum(tokens.values())
    p = {s: n / total for s, n in tokens.items()}

    def measures(a):
        x = {s: v**a for s, v in p.items()}
        z = sum(x.values())
        ratio = [x[s] / p[s] for s in p]
        return -sum(v / z * math.log(v / z) for v in x.values()), passes * max(ratio) / min(ratio)

    target = measures(1.0)[0] + entropy * (math.log(len(p)) - measures(1.0)[0])
    low, high = 0.0, 1.0
    for _ in range(30):
        a = (low + high) / 2
        h, epochs = measures(a)
        low, high = (a, high) if h > target or epochs > max_epochs else (low, a)
    a = round(high, 6)
    raw = {s: v**a for s, v in p.items()}
    scale = passes / min(raw[s] / p[s] for s in p)
    out = {}
    for s in p:
        budget = int(raw[s] * scale * total + 0.5)
        whole, rest = divmod(budget, tokens[s])
        blocks = -(-docs[s] // block_docs)
        place = {d: _hash(Small(seed), s, d) for d, t, _ in rows if t == s}
        order = sorted((_hash(Small(seed + 1), s, place[d] % blocks), place[d], d, n) for d, t, n in rows if t == s)
        before = 0
        for _, _, d, n in order:
            out[d] = (round(raw[s] / sum(raw.values()), 9), whole + (before < rest and n > 0))
            before += n
    return out


def packed(rows, capacity, per_source):
    """doc_id -> bin of the rest of each of (doc_id, source, clusters, length), without repeated ids: best fit over all bins."""
    bins, at = [], {}
    for rest, length, d, s, own in sorted(((n % capacity, n, d, s, set(c)) for d, s, c, n in rows if n % capacity), key=lambda r: (-r[0], -r[1], r[2])):
        fits = [b for b in bins if b["left"] >= rest and not own & b["clusters"] and b["sources"].count(s) < per_source]
        b = min(fits, key=lambda b: b["left"], default=None)
        if b is None:
            b = {"no": len(bins), "left": capacity, "clusters": set(), "sources": []}
            bins.append(b)
        b["left"] -= rest
        b["clusters"] |= own
        b["sources"].append(s)
        at[d] = b["no"], capacity - b["left"] - rest
    return at


def disclosing(rows, support, smoothing, generalise_at, remove_at):
    """doc_id -> added spans (kind, start, end) of (doc_id, text) without repeated ids."""
    import math

    import regex

    word = regex.compile(r"\p{L}[\p{L}\p{N}_'’-]*+")
    n, found = len(rows), []
    for d, t in rows:
        t = t or ""
        base = base_spans(t)
        words = [(m[0].lower(), m.start(), m.end()) for m in word.finditer(t)]
        free = [w for w in words if not any(w[1] < e and w[2] > s for _, s, e in base)]
        entities = set()
        for k, s, e in base:
            v = t[s:e].lower() if k == "email" else t[s:e] if k == "ip" else re.sub("[^0-9]", "", t[s:e])
            entities |= {(k, v), (k, "group", v.split("@")[-1] if k == "email" else ".".join(v.split(".")[:2]) if k == "ip" else v[: 6 if k == "card" else 5])}
        found.append((d, t, entities, free))
    n_term, n_entity, n_both, texts, both_texts = {}, {}, {}, {}, {}
    for _, t, entities, free in found:
        own = {w for w, _, _ in free}
        for w in own:
            n_term[w] = n_term.get(w, 0) + 1
        for x in entities:
            n_entity[x] = n_entity.get(x, 0) + 1
            texts.setdefault(x, set()).add(t)
            for w in own:
                n_both[x, w] = n_both.get((x, w), 0) + 1
                both_texts.setdefault((x, w), set()).add(t)
    kinds = {}
    for (x, w), c in n_both.items():
        if len(texts[x]) >= support and len(both_texts[x, w]) >= support and n_entity[x] < n:
            told = math.log(n * c / (n_entity[x] * (n_term[w] + smoothing))) / math.log(n / n_entity[x])
            if told >= generalise_at:
                kinds[x, w] = "removed" if told >= remove_at else "term"
    out = {}
    for d, _, entities, free in found:
        out[d] = []
        for w, s, e in free:
            got = {kinds.get((x, w)) for x in entities} - {None}
            if got:
                out[d].append(("removed" if "removed" in got else "term", s, e))
        out[d].sort(key=lambda x: (["term", "removed"].index(x[0]), x[1]))
    return out
