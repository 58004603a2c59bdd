"""Each operator against a brute-force version, and on the odd inputs that it must take."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import common, components, decontaminate, jaccard, knn, langid, packing, pii, quality, substrings, training_order, warc
from gridloom.llm.tokens import WordIds
from gridloom.llm.words import word_chunks

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rid long, key string, row string, th long"


def documents(spark, texts, lang="en"):
    """Rows with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, "src0", None if t is None else len(t), 5, "k", "r", 1) for i, t in texts], DOCS)


def words(rng, n, vocabulary=4000):
    return " ".join(f"w{x}" for x in (rng.zipf(1.3, n) % vocabulary))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, repeated rows, shared passages, nulls, empty and long texts."""
    rng = np.random.default_rng(3)
    base = [words(rng, int(n)) for n in rng.integers(3, 300, 40)]
    passage = words(rng, 60)
    out = [(i, t) for i, t in enumerate(base)]
    out += [(100 + i, t) for i, t in enumerate(base[:12])]
    near = base[20].split()
    for k in range(8):
        edited = list(near)
        edited[k * 7 % len(edited)] = f"edit{k}"
        out.append((200 + k, " ".join(edited)))
    out += [(300 + k, words(rng, 30) + " " + passage + "\t\n" + words(rng, 20)) for k in range(6)]
    out += [(400, None), (401, ""), (402, " \n "), (403, "one two"), (404, "one two"), (405, words(rng, 20_000)), (406, " ".join(["same"] * 500)), (407, "a b \x1c c " * 30), (0, base[0]), (0, base[0]), (None, base[1])]
    return out


EMPTY = []


# --- 1 ---


def test_jaccard(spark, corpus):
    rows = [r for r in corpus if r[0] is not None]
    got = jaccard.join(documents(spark, rows)).select("doc_id", "class_id", "n_links").collect()
    sets = [(i, frozenset(tuple(w[j : j + min(5, len(w))]) for j in range(len(w) - min(5, len(w)) + 1)) if (w := (t or "").encode().split()) else frozenset()) for i, t in rows]
    parent, links = list(range(len(sets))), [0] * len(sets)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 1000 * len(x & y) >= 800 * len(x | y):
                links[a], links[b] = links[a] + 1, links[b] + 1
                parent[root(a)] = root(b)
    least = collections.defaultdict(lambda: 1 << 60)
    for a, (i, _) in enumerate(sets):
        least[root(a)] = min(least[root(a)], i)
    assert sorted(map(tuple, got)) == sorted((i, least[root(a)], links[a]) for a, (i, _) in enumerate(sets))


def test_jaccard_large_buckets(spark, monkeypatch):
    """Buckets beyond the limit at every level, and families of several blocks."""
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 2000)
    rng = np.random.default_rng(4)
    base = words(rng, 120).split()
    rows = []
    for i in range(60):
        t = list(base)
        t[i % 120] = f"x{i}"
        rows.append((i, " ".join(t)))
    rows += [(1000 + i, words(rng, 60)) for i in range(40)]
    keep = jaccard.buckets.__defaults__
    monkeypatch.setattr(jaccard.buckets, "__defaults__", (2, 8))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.join(documents(spark, rows)).collect()}
    assert keep != jaccard.buckets.__defaults__
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    for i in sets:
        assert got[i][1] == sum(1000 * len(sets[i] & sets[j]) >= 800 * len(sets[i] | sets[j]) for j in sets if j != i)
        assert got[i][0] == (0 if i < 60 else i)


def test_jaccard_large_families(spark, monkeypatch):
    """A family of many blocks: near copies close to its pivot, others far from it, copies of both, and repeated rows."""
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 4000)
    rng, base = np.random.default_rng(9), [f"b{j}" for j in range(200)]
    rows = []
    for i in range(150):
        t = list(base)
        for k in rng.integers(0, 200, int(rng.integers(0, 5)) if i % 3 else 1):
            t[k] = f"x{i}"
        rows.append((i, " ".join(t)))
    rows += [(200 + i, rows[i][1]) for i in range(0, 60, 4)] + [rows[3], rows[3], (400, " ".join(base[:180])), (401, " ".join(base + ["more"] * 3))]
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for _, t in rows for w in [t.split()]]
    linked = np.array([[1000 * len(a & b) >= 800 * len(a | b) for a in sets] for b in sets])
    want = collections.Counter((i, n - 1) for (i, _), n in zip(rows, linked.sum(1).tolist(), strict=True))
    seen, large = [], jaccard._large_families

    def counted(*a):
        out = large(*a)
        seen.append((out[0].count(), out[1].filter("b is not null").count()))
        return out

    monkeypatch.setattr(jaccard, "_large_families", counted)
    got = jaccard.join(documents(spark, rows)).collect()
    assert collections.Counter((r["doc_id"], r["n_links"]) for r in got) == want
    assert linked.all(1).sum() < len(rows) and {r["class_id"] for r in got} == {0}
    assert seen and seen[0][1] > 40


def test_jaccard_meets_in_split_buckets(spark, monkeypatch):
    """Pairs of similarity 0.8, all with one boilerplate of 70 % of their union, meet in some bucket."""
    rng, held, buckets = np.random.default_rng(11), [], jaccard.buckets

    def seen(*a):
        found = buckets(*a)
        held.extend(part.collect() for part in found)
        return found

    monkeypatch.setattr(jaccard, "buckets", seen)
    fresh = lambda n: [f"v{x}" for x in rng.integers(0, 1 << 40, n)]
    boilerplate, rows = fresh(74), []
    for i in range(600):
        both = boilerplate + fresh(10)
        rows += [(2 * i + k, " ".join(both + fresh(10))) for k in range(2)]
    got = {r["doc_id"]: r for r in jaccard.join(documents(spark, rows)).collect()}
    at = collections.defaultdict(set)
    for part in held:
        for r in part:
            at[r["rid"]].add(r["key"])
    met = [bool(at[got[2 * i]["rid"]] & at[got[2 * i + 1]["rid"]]) for i in range(600)]
    assert sum(met) >= 599
    assert all(r["n_links"] == 1 and r["class_id"] == i // 2 * 2 for i, r in got.items())


def test_representatives(spark, corpus):
    kept = jaccard.representatives(documents(spark, corpus))
    assert kept.columns == documents(spark, EMPTY).columns
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert ids.count(0) == 1 and not {100, 101, 404} & set(ids) and {400, 401, 402} <= set(ids)


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(i, i + 1) for i in range(60)] + [(1000, int(x)) for x in rng.integers(2000, 2100, 80)] + [(5000, 5001), (5001, 5000), (7, 7)]
    got = {r[0]: r[1] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[5001] == 5000
    assert all(got[b] == 1000 for a, b in edges if a == 1000)


# --- 2 ---

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    def valid(kind, v):
        n = re.sub("[^0-9]", "", v)
        if kind == "ip":
            return all(int(x) <= 255 for x in v.split("."))
        if kind == "card":
            total = sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for k, c in enumerate(reversed(n)))
            return 13 <= len(n) <= 19 and total % 10 == 0
        return kind == "email" or 9 <= len(n) <= 15

    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text) if valid(k, m[0])]


ODD = ["a@b.c_d@e.f x@y z@w.q-", "1.2.3.4.5.6.7.8 256.1.1.1 000000000000000000255.1.1.1", "4111 1111-1111 1111 4111111111111112 é😀 4111111111111111", "+1 (505) 555-1941. +12 +1234567890123456 +1 2 3 4 5 6 7 8 9-", "@@@ ..@a.b %@-.-", "1" * 30_000, "a." * 20_000, "+1" + " " * 5000 + "2", None, "", "x@y.z" * 300]


def test_pii_base(spark):
    got = {r["doc_id"]: r for r in pii.find(documents(spark, list(enumerate(ODD)))).collect()}
    for i, t in enumerate(ODD):
        want = brute_spans(t or "")
        assert [tuple(s) for s in got[i]["base"]] == want
        assert all(got[i][f"n_{k}"] == sum(s[0] == k for s in want) for k in BASE)


def test_pii_discovers(spark):
    """A pattern that precedes enough known identifiers finds one of another form; ordinary contexts find none."""
    rows = [(i, f"the office said my mail: user{i}@host.org and left at 10 today") for i in range(40)]
    rows += [(100, "the office said my mail: bob#at#host7 and left"), (101, "version 2.0 of the text")]
    got = {r["doc_id"]: r for r in pii.find(documents(spark, rows)).collect()}
    found = [tuple(s) for s in got[100]["spans"]]
    assert found == [("email", 25, 37)] and got[100]["base"] == []
    assert got[101]["spans"] == [] and all(len(got[i]["spans"]) == 1 for i in range(40))


def test_pii_discovers_in_a_large_table(spark):
    """A pattern before a few identifiers counts among thousands of others as it does alone; counts are those of all texts."""
    few = [(i, f"and the secret token: user{i}@host.org is") for i in range(6)] + [(100, "and the secret token: bob#at#host7 is")]
    many = [(1000 + i, f"the office said my mail: user{i}@host.org and left") for i in range(8000)]
    for rows in (few, few + many):
        got = {r["doc_id"]: r for r in pii.find(documents(spark, rows)).filter("doc_id <= 100").collect()}
        assert [tuple(s) for s in got[100]["spans"]] == [("email", 22, 34)]
    wanted = spark.createDataFrame([("secret token:",), ("my mail:",), ("not there",)], "pattern string")
    counts = pii.pattern_counts(documents(spark, few + many + [(5, "my mail: My  MAIL: x"), (6, None)]), wanted)
    assert {tuple(r) for r in counts.select("pattern", "occurrences").collect()} == {("secret token:", 7), ("my mail:", 8002)}


def brute_discovery(rows, support=5, confident=0.8, rounds=3):
    """The spans that patterns add, by plain loops: (row, kind, start, end)."""
    kinds, edges, others, pairs = list(BASE), collections.Counter(), [], collections.Counter()
    for n, (_, text) in enumerate(rows):
        text = text or ""
        w = re.split(r"[ \t\n\x0b\f\r]+", text.lower())
        pairs.update(zip(w, w[1:], strict=False))
        base = brute_spans(text)
        for kind, p in [*BASE.items(), (None, r"(?<!\S)[^\s0-9@]*[0-9@]\S*")]:
            at = 0
            for m in re.finditer(p, text, re.ASCII):
                gap = (" " if at == 0 else "") + text[at : m.start()].lower()
                at = m.end()
                if kind and (kind, m.start(), m.end()) not in base or not kind and any(s < m.end() and m.start() < e for _, s, e in base):
                    continue
                if before := re.search(r"\s(\S+)\s+(\S+)\s+\S*$", gap, re.ASCII):
                    pattern = f"{before[1]} {before[2]}"
                    edges[pattern, m[0].lower(), kind] += 1
                    if not kind:
                        others.append((n, m.start(), m[0], pattern))
    by = collections.defaultdict(list)
    for (pattern, value, kind), k in edges.items():
        by[pattern].append((value, kind, k))
    by = {p: e for p, e in by.items() if len({v for v, *_ in e}) >= support and any(kind for _, kind, _ in e)}
    belief, score = {}, {}
    for _ in range(rounds):
        sure = lambda v, kind: 1.0 if kind else belief.get(v, 0.0)
        score = {p: (sum(k * sure(v, kind) for v, kind, k in e) / (max(sum(k for *_, k in e), pairs[tuple(p.split(" "))]) + 1), len({v for v, kind, _ in e if sure(v, kind) > 0.5})) for p, e in by.items()}
        belief = {}
        for p, e in by.items():
            for v, *_ in e:
                belief[v] = 1 - (1 - belief.get(v, 0.0)) * (1 - score[p][0])
    out = set()
    for n, start, value, p in others:
        if p in score and score[p][0] >= confident and score[p][1] >= support:
            total = collections.Counter()
            for _, kind, k in by[p]:
                if kind:
                    total[kind] += k
            kind = max(total, key=lambda k: (total[k], -kinds.index(k)))
            if left := len(value.rstrip("\"'.,;:!?)]>")):
                out.add((n, kind, start, start + left))
    return out


def test_pii_against_brute_force(spark):
    """Base and discovered spans of random texts with good, mixed and bad patterns, glued tokens, ties and rows without an id."""
    rng = np.random.default_rng(41)
    forms = [lambda: f"user{rng.integers(99)}@host{rng.integers(9)}.org", lambda: f"+1 505 {rng.integers(100, 999)} {rng.integers(1000, 9999)}", lambda: f"10.0.{rng.integers(300)}.{rng.integers(99)}", lambda: f"x{rng.integers(99)}#at#y", lambda: str(rng.integers(1 << 40)), lambda: "(a1).", lambda: "plain", lambda: f"tel:+1505555{rng.integers(1000, 9999)}", lambda: "4111 1111 1111 1111"]
    lead = ["my mail:", "call me", "Write  to", "the number", "see also\n", "at", "server ip"]
    rows = []
    for i in range(400):
        parts = []
        for _ in range(int(rng.integers(0, 6))):
            k = int(rng.integers(len(lead)))
            # leads have forms of their own, more or less
            form = forms[(k if rng.random() < 0.9 else int(rng.integers(len(forms)))) % len(forms)] if rng.random() < 0.8 else forms[3]
            parts += [*rng.choice(["some", "word", "or,", "other"], int(rng.integers(0, 4))).tolist(), lead[k], form()]
        rows.append((i if i % 50 else None, " ".join(parts)))
    rows += [(900 + i, f"token id is Key{i}@a.bc and") for i in range(6)] + [(920 + i, f"token id is +150555512{i:02d} and") for i in range(6)] + [(940, "token id is k-77, and"), (941, None), (942, "")]
    want = collections.Counter()
    extra = collections.defaultdict(list)
    for n, *span in brute_discovery(rows):
        extra[n].append(tuple(span))
    for n, (i, text) in enumerate(rows):
        want[i, tuple(sorted(brute_spans(text or "") + extra[n], key=lambda s: (list(BASE).index(s[0]), s[1])))] += 1
    assert sum(map(len, extra.values())) > 30 and any(s[0] == "email" for s in extra[len(rows) - 3])
    got = collections.Counter((r["doc_id"], tuple(map(tuple, r["spans"]))) for r in pii.find(documents(spark, rows)).collect())
    assert got == want


def test_pii_of_long_texts(spark):
    """Pages of numbers and of addresses: time in proportion to their length, spans and masks as by hand."""
    numbers = " ".join(str(i * 7919 % 10**9) for i in range(60_000))
    mails = " ".join(f"u{i}@h.org é😀" if i % 3 else f"10.0.0.{i % 256}@z.org" for i in range(20_000))
    df = documents(spark, [(1, numbers), (2, mails)])
    got = {r["doc_id"]: r for r in pii.find(df).collect()}
    assert [[tuple(s) for s in got[i]["base"]] for i in (1, 2)] == [brute_spans(numbers), brute_spans(mails)]
    masked = {r["doc_id"]: r["text"] for r in pii.mask(df).collect()}
    out, at = [], 0
    for kind, start, end in sorted(map(tuple, got[2]["spans"]), key=lambda s: (s[1], s[2], s[0])):
        out += [mails[at:start], f"<{kind}>"] if start >= at else []
        at = max(at, end)
    assert masked[2] == "".join(out) + mails[at:]


def test_pii_mask(spark):
    df = documents(spark, [(1, "mail a@b.cc or +1 (505) 555-1941!"), (None, "a@b.cc"), (3, None), (1, "mail a@b.cc or +1 (505) 555-1941!")])
    got = sorted((r["doc_id"] or 0, r["text"], r["n_chars"]) for r in pii.mask(df).select("doc_id", F.coalesce("text", F.lit("-")).alias("text"), "n_chars").collect() if r["text"] != "-")
    assert got == [(0, "<email>", 7), (1, "mail <email> or <phone>!", 24), (1, "mail <email> or <phone>!", 24)]
    plan = pii.base_spans(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- 3, 5 ---

TEXTS = {"en": "the cat sat on the mat and the dog was there with them ", "de": "der hund und die katze sind nicht in dem haus mit ihnen ", "fr": "le chat est sur la table et les chiens sont dans la maison "}


def test_language(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(240):
        lang = list(TEXTS)[i % 3]
        text = " ".join(rng.permutation(TEXTS[lang].split() * 4).tolist())
        rows.append((i, text, lang if i % 7 else "de", f"www.h{i % 5}.{lang}", 0))
    rows += [(900, None, "en", None, 0), (901, "", None, "www.h1.de", 0), (902, "\x01\x02\x03\x04\x05\x06\x07" * 60, None, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, host long")
    got = langid.identify(df, declared="lang", host="source")
    assert got.columns == [*df.columns, "language", "posterior", "accepted"]
    by = {r["doc_id"]: r for r in got.collect()}
    assert all(by[i]["language"] == list(TEXTS)[i % 3] and by[i]["accepted"] for i in range(240))
    assert not any(by[i]["accepted"] for i in (900, 901, 902))
    narrow = {r["doc_id"]: r["language"] for r in langid.identify(df, declared="lang", host="source", keep=["doc_id"]).collect()}
    assert narrow == {i: r["language"] for i, r in by.items()}
    assert langid.identify(df.limit(0), declared="lang", host="source").count() == 0


def test_language_of_markup(spark):
    rows = [(i, f"<html lang='{lang}'><p>" + TEXTS[lang] * 3, f"https://www.x{i % 4}.{lang}/p?q=1") for i, lang in enumerate(list(TEXTS) * 30)]
    got = langid.identify(spark.createDataFrame(rows, "page_id long, html string, url string"), text="html", markup="html", address="url")
    assert got.filter("accepted").count() == 90
    assert {r[0] for r in got.select("language").distinct().collect()} == set(TEXTS)


def brute_language(rows):
    """Language and posterior of (text, declared, host) rows, evidence by evidence, by plain loops."""
    def grams(text):
        b = bytes(32 if c in b"\t\n\x0b\x0c\r" else 48 if 48 <= c < 58 else c + 32 if 65 <= c < 91 else c for c in b" " + text.encode() + b" ")
        return [((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761 % 2**32) >> 16 for i in range(len(b) - 2)]

    def total(kind):
        out = collections.defaultdict(lambda: np.zeros(n))
        for (d, h, s), k in seen:
            out[{"d": d, "s": s, "h": h}[kind]][k] += 1
        return out

    tag = lambda d: m[1] if d and (m := re.match(r"([a-z]{2,3})(?:$|[-_])", d.strip().lower())) else None
    rows = [(t or "", tag(d), h or "", (m[1] if (m := re.search(r"\.([A-Za-z0-9-]+)$", h or "")) else "")) for t, d, h in rows]
    names = [x for x, _ in sorted(collections.Counter(d for _, d, *_ in rows if d).items(), key=lambda x: (-x[1], x[0]))]
    n, table = len(names), np.zeros((len(names) + 1, 1 << 16))
    for t, d, *_ in rows:
        if d:
            np.add.at(table[names.index(d)], grams(t), 1)
    every = table.sum(0) + 0.5
    table += 0.5 + 2000 * every / every.sum()
    table[n] = 1
    logs = np.log(table / table.sum(1, keepdims=True))
    liks = [logs[:, grams(t)].sum(1) / 3 for t, *_ in rows]
    seen = [(r[1:], int(np.argmax(x))) for r, x in zip(rows, liks, strict=True) if np.argmax(x) < n]
    overall = np.maximum(1, sum((c for c in total("d").values()), np.zeros(n)))
    share = overall / overall.sum()
    by_d, by_s, by_h = total("d"), total("s"), total("h")
    like = lambda c: np.log((c + 10 * c.sum() / overall.sum()) / (overall + 10))
    out = []
    for (t, d, h, s), x in zip(rows, liks, strict=True):
        prior = np.full(n, -np.log(n))
        if h in by_h:
            prior = np.log((by_h[h] + 10 * (by_s[s] + 10 * share) / (by_s[s].sum() + 10)) / (by_h[h].sum() + 10))
        z = prior + x[:n] + (like(by_d[d]) if d in by_d else 0) + (like(by_s[s]) if s and s in by_s else 0)
        z = np.append(z, np.log(1e-3) - np.log(n) * (2 if s else 1) + x[n])
        k = int(np.argmax(z))
        p = 1 / np.exp(z - z.max()).sum()
        out.append((names[k] if k < n else None, p, bool(t.strip(" ")) and k < n and p >= 0.5))
    return out


def test_language_against_brute_force(spark, monkeypatch):
    """All evidence together; rare languages, language tags, odd declarations; blocks of languages and pieces of texts change nothing."""
    rng = np.random.default_rng(51)
    rows = []
    for i in range(160):
        lang = list(TEXTS)[i % 3]
        text = " ".join(rng.permutation(TEXTS[lang].split()).tolist()[: int(rng.integers(1, 12))])
        rows.append((text, [lang, lang.upper() + "-XX", "de", None, "not a tag"][i % 5], f"h{i % 6}.{lang}" if i % 4 else ["plain", None][i % 8 // 4]))
    rows += [("hola que tal estamos todos aqui", "es", "h.es"), ("hola que tal", None, "h.es"), ("le", "fr_CA", "h2.fr"), ("le", None, None), ("", "de", "h1.de"), (None, None, "h1.de"), ("\x01\x02" * 50, None, None), ("und " * 3000, "de", "h1.de")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    want = brute_language(rows)
    monkeypatch.setattr(langid, "PIECE", 1000)
    for block in (64, 2):
        monkeypatch.setattr(langid, "BLOCK", block)
        got = langid.identify(df, declared="lang", host="source").orderBy("doc_id").collect()
        assert [(r["language"], r["accepted"]) for r in got] == [(x, a) for x, _, a in want]
        assert np.allclose([r["posterior"] for r in got], [p for _, p, _ in want], atol=1e-3)
    # each evidence decides some row
    by = lambda **x: [r["language"] for r in langid.identify(df, **x).orderBy("doc_id").collect()]
    full = [x for x, *_ in want]
    assert by(declared="lang") != full and brute_language([(t, d, h and h.split(".")[0]) for t, d, h in rows]) != want and want[161][0] == "es"
    assert any(brute_language([(t, d if i != j else None, h) for i, (t, d, h) in enumerate(rows)])[j][0] != full[j] for j in range(10, 40))


def test_markup(spark):
    long = "<html>" + "<!-- x -->" * 1000 + "<html dir=ltr lang=fr-CA><script>var the = 1 < 2;</script><p>un<b>deux</b>"
    df = spark.createDataFrame([(1, long, "http://u:p@WWW.a.fr:80/x"), (2, None, None)], "page_id long, html string, url string")
    rows = {r["row"]["page_id"]: r for r in langid.evidence(df.withColumn("text", langid.plain_text("html")), markup="html", address="url").collect()}
    assert (rows[1]["declared"], rows[1]["host"], rows[1]["suffix"]) == ("fr", "www.a.fr", "fr") and rows[1]["text"].split() == ["un", "deux"]
    assert (rows[2]["declared"], rows[2]["host"], rows[2]["suffix"], rows[2]["text"]) == (None, "", "", None)


def test_quality(spark):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        text = words(rng, 60) if good else " ".join(f"W{x}!!" for x in rng.integers(0, 500, 60))
        rows.append((i, text))
        labels.append((i, int(good), 0))
    df, lab = documents(spark, [*rows, (900, None), (901, "")]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.score(df, quality.fit(df, lab, "quality")).collect()}
    held = [i for i in range(400) if got[i]["held_out"]]
    assert held == [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i]["predicted"] == int(i % 3 > 0) for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == 402
    # other labels of held-out rows change nothing
    other = lab.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in quality.score(df, quality.fit(df, other, "quality")).collect()}
    assert all(again[i] == got[i]["score"] for i in got)
    none = quality.score(df, quality.fit(df, lab.limit(0), "quality")).collect()
    assert {r["score"] for r in none} == {0.5}


def test_quality_of_text_without_spaces(spark, monkeypatch):
    """What comes after equal starts decides, and pieces change no feature."""
    rng = np.random.default_rng(13)
    rows = [(i, "start" * 12 + "".join(rng.choice(list("abcdef" if i % 2 else "uvwxyz"), 300))) for i in range(200)]
    df = documents(spark, rows)
    got = {r["doc_id"]: r for r in quality.score(df, quality.fit(df, spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int"), "quality")).collect()}
    assert np.mean([r["predicted"] == i % 2 for i, r in got.items() if r["held_out"]]) > 0.95
    whole = quality.features(rows[0][1].encode())
    monkeypatch.setattr(quality, "PIECE", 7)
    monkeypatch.setattr(quality, "BATCH", 20)
    assert all(np.allclose(a, b) for a, b in zip(whole, quality.features(rows[0][1].encode()), strict=True))


# --- 4, 10 ---


def text_batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])


def library_ids(texts, end=True):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return [np.asarray(t.encode(x or "", add_special_tokens=False).ids + [1] * end, "<u4") for x in texts]


def test_words():
    """Words, their joins and hashes, for chunks of every size; equal words and no others have equal hashes."""
    rng = np.random.default_rng(21)
    texts = ["", " ", "a", " ab  c\n", None, "é ü", "x" * 1000 + " y " + "x" * 1000, "q" * 9 + " " + "q" * 17, "\x00 a\x00 b \x1c"]
    texts += ["".join(rng.choice(list("ab \t\n\x0b\x0c\r\x00z"), int(rng.integers(0, 60)))) for _ in range(200)]
    seen = {}
    for size in (1, 500, 1 << 20):
        at = 0
        for w in word_chunks(iter([text_batch(texts).slice(1)]), "text", size):
            low, high = w.hashes()
            keep = np.arange(len(w.start)) % 3 != 0
            for i, (whole, part) in enumerate(zip(w.joined(), w.joined(keep), strict=True)):
                own, lo, hi = (texts[1 + at] or "").encode().split(), w.first[i], w.first[i + 1]
                at += 1
                assert bytes(whole) == b" ".join(own) and bytes(part) == b" ".join(x for x, k in zip(own, keep[lo:hi], strict=True) if k)
                assert w.words(np.arange(lo, hi)) == own
                assert all(seen.setdefault(x, h) == h for x, h in zip(own, zip(low[lo:hi].tolist(), high[lo:hi].tolist(), strict=True), strict=True))
    assert len({h[0] for h in seen.values()}) == len({h[1] for h in seen.values()}) == len(seen)


def test_word_ids():
    rng = np.random.default_rng(22)
    texts = ["Don't it's you'RE", "a<|endoftext|>b  x", "é é İstanbul ǅ ß ﬁ ½ 12ab a_b __ x y", "日本語 テスト", "the, THE. thinghaton*** reed!!", "a" * 700, "", "\x1c\x85 a\x1cb", "aaaa abab ababab."]
    texts += ["".join(rng.choice(list("abcZÀÉéÖ×÷ßÿĀİı.,-'(9 \n\t漢😀ÞŸñȺ\u0301\x00  "), int(rng.integers(0, 40)))) for _ in range(1500)]
    ids = WordIds()
    for size in (1 << 20, 300):
        got = []
        for w in word_chunks(iter([text_batch(texts)]), "text", size):
            flat, first = ids.documents(w, 1)
            got += [flat[a:b].tolist() for a, b in zip(first, first[1:], strict=False)]
        assert got == [x.tolist() for x in library_ids(texts)]


def test_packing(spark, corpus):
    big = 2**60 + 1
    rows = [*corpus, (big, "an id that doubles cannot hold"), (None, "beside a row without an id")]
    got = packing.pack(packing.stage(packing.pieces(documents(spark, rows), None, 256), "p"), 256, group_rows=40).toArrow().to_pylist()
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        held.sort()
        assert [o for o, _ in held] == np.cumsum([0, *(n for _, n in held[:-1])]).tolist() and sum(n for _, n in held) <= 256
    want = collections.Counter((i, k, a, len(x[a : a + 256]), zlib.crc32(x[a : a + 256].tobytes())) for (i, _), x in zip(rows, library_ids([t for _, t in rows]), strict=True) for k, a in enumerate(range(0, len(x), 256)))
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert len(bins) <= 1.1 * -(-sum(r["length"] for r in got) // 256) + 1


def test_best_two_fit():
    rng = np.random.default_rng(0)
    for _ in range(30):
        lengths = rng.integers(1, 101, int(rng.integers(0, 80)))
        bins = packing.best_two_fit(lengths, 100)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert all(lengths[b].sum() <= 100 for b in bins)
    # greedy would leave 60 + 30; the pair 20 + 20 fits 40 exactly
    assert [sorted(np.array([60, 30, 20, 20])[b].tolist()) for b in packing.best_two_fit(np.array([60, 30, 20, 20]), 100)][0] == [20, 20, 60]


def test_training_order(spark, corpus):
    """Every record, its place, documents and ids against the stream cut by hand, the file read in order."""
    written, folder = training_order.materialise(documents(spark, corpus).coalesce(1), seq_len=128, shard_sequences=16, key=7)
    rows = training_order.read_slots(written, folder).collect()
    ids = library_ids([t for _, t in corpus])
    stream, owner = np.concatenate(ids), np.repeat(np.arange(len(ids)), list(map(len, ids)))
    n = -(-len(stream) // 128)
    order = training_order.Feistel(n, key=7)
    slots = order(np.arange(n)).tolist()
    assert [r["slot"] for r in sorted(rows, key=lambda r: r["number"])] == slots and [r["slot"] for r in rows] == list(range(n))
    path, files = folder.removeprefix("file://"), {}
    for r in rows:
        own = stream[128 * r["number"] : 128 * r["number"] + 128]
        with open(f"{path}/{r['file']}", "rb") as f:
            f.seek(r["byte_offset"])
            got = np.frombuffer(f.read(r["stride"]), "<u2")
        assert got.tolist() == own.tolist() + [1] * (128 - len(own)) and r["n_tokens"] == len(own)
        assert r["shard"] == r["slot"] // 16 and r["byte_offset"] == r["slot"] % 16 * r["stride"] and files.setdefault(r["shard"], r["file"]) == r["file"]
        assert r["doc_ids"] == [corpus[d][0] for d in dict.fromkeys(owner[128 * r["number"] : 128 * r["number"] + 128].tolist())]
    assert order(np.asarray([r["slot"] for r in rows]), back=True).tolist() == [r["number"] for r in rows]
    assert training_order.read_slots(written, folder, first=n - 5).count() == 5
    # several tasks, chunks and partitions give the same tokens in all
    many, other = training_order.materialise(documents(spark, corpus).repartition(3), seq_len=64, shard_sequences=2)
    assert sum(r["n_tokens"] for r in training_order.read_slots(many, other).collect()) == len(stream)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4096])
def test_feistel(n):
    order = training_order.Feistel(n, key=9)
    slots = order(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n)) and (order(slots, back=True) == np.arange(n)).all()


# --- 6 ---


def brute_factors(rows):
    """Each row's greedy parse: at every word the longest run that starts earlier (20 words or more), wherever it lies; runs that touch are one factor."""
    seen, out = set(), []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(k)
        edges = np.flatnonzero(np.diff(np.r_[0, gone, 0])).reshape(-1, 2).tolist()
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest(), tuple(map(tuple, edges))))
    return collections.Counter(out)


def parsed(df):
    return collections.Counter((*tuple(r)[:4], tuple(map(tuple, r["factors"]))) for r in substrings.parse(df).collect())


def test_substrings(spark, corpus):
    rows = sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0))
    assert parsed(documents(spark, rows)) == brute_factors(rows)


def test_substrings_of_few_words(spark):
    """Texts over two or three words, where anchors tie and windows repeat inside a text and across many; and one passage in all of them."""
    rng = np.random.default_rng(31)
    line = " ".join(f"l{j}" for j in range(25))
    rows = [(i, " ".join(rng.choice(["a", "b", "c"][: 1 + i % 3], int(rng.integers(0, 120))))) for i in range(60)]
    rows += [(100 + i, f"start{i} x{i % 7} {line} id{i} " + " ".join(rng.choice(["a", "b"], 30))) for i in range(150)]
    rows += [(400 + i, " ".join(f"l{j}" for j in range(i % 6, 25 - i % 4))) for i in range(24)]
    assert parsed(documents(spark, rows)) == brute_factors(rows)


def test_hot_join(spark):
    """Keys of every weight give the rows of a plain join."""
    rows = spark.range(3000).selectExpr("id", "case when id < 1000 then 7 else id % 40 end as key")
    counted = rows.groupBy("key").agg(F.count("*").alias("n")).filter("key % 2 = 1")
    for most in (1, 3, 50, 1000):
        got = common.hot_join(rows, counted, ["key"], most=most).select("id", "key", "n").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, rows.join(counted, "key").select("id", "key", "n").collect()))


# --- 7 ---


def test_leaks(spark, corpus):
    rng = np.random.default_rng(8)
    items = [(k, " ".join(f"q{x}" if x > 3 else f"w{x}" for x in rng.zipf(1.5, 40) % 900 + 1) + ". The answer is " + " ".join(f"z{k}x{j}" for j in range(4))) for k in range(12)]
    docs = [r for r in corpus if r[0] is not None]
    leaked = {}
    for k in range(6):
        text = items[k][1].split()
        if k % 2:
            text = [t if j % 6 else "other" for j, t in enumerate(text[:-6])] + text[-6:]
        docs.append((5000 + k, words(rng, 70) + " " + " ".join(text).upper() + " " + words(rng, 90)))
        leaked[5000 + k] = k
    benchmark = spark.createDataFrame([*items, (90, None), (91, ""), (92, "tiny item")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(documents(spark, docs), benchmark).collect()}
    assert got == set(leaked.items())
    left = decontaminate.clean(documents(spark, docs), benchmark)
    assert left.count() == len(docs) - 6 and left.columns == documents(spark, EMPTY).columns
    assert decontaminate.leaks(documents(spark, docs), benchmark.limit(0)).count() == 0


def test_leaks_of_a_large_table(spark):
    """A paraphrase with common words is found whatever the number of documents."""
    rng = np.random.default_rng(12)
    items = [(k, " ".join(f"q{k}x{j}" for j in range(36)) + ". The answer is " + f"z{k}") for k in range(5)]
    common = [w for _, t in items for w in t.replace(".", "").split()]
    docs = [(i, " ".join(rng.permutation([*(w for w in common if rng.random() < 0.3), *(f"s{x}" for x in rng.integers(0, 9000, 400))]).tolist())) for i in range(60)]
    for k, t in items:
        w = t.split()
        other = set(range(1, 36, 2)[:14])
        docs.append((500 + k, " ".join(f"o{k}y{j}" if j in other else x for j, x in enumerate(w)) + " " + words(rng, 60)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for copies in (1, 400):
        table = documents(spark, docs).crossJoin(spark.range(copies).select()).repartition(4)
        got = {(r[0], r[1]) for r in decontaminate.leaks(table, benchmark).select("doc_id", "item_id").distinct().collect()}
        assert got == {(500 + k, k) for k in range(5)}


def test_leaks_against_the_rule(spark, corpus):
    """Candidates miss at most a tenth of what the rule itself finds among all passages, the rarest words swapped out; and nothing else is found."""
    rng = np.random.default_rng(14)
    vocabulary = [f"w{x}" for x in range(1, 900)]
    items = []
    for k in range(24):
        body = [vocabulary[x] for x in rng.zipf(1.4, 30) % 899]
        items.append((k, " ".join([*body[:18], f"r{k}a", f"r{k}b", *body[18:], f"r{k}c."]) + " " + " ".join(f"z{k}x{j}" for j in range(4))))
    items += [(90, "Tiny ITEM, here"), (91, " ".join(vocabulary[:130]) + ". end")]
    docs = [(i, t) for i, t in corpus if t is None or len(t) < 5000] + [(600, "no tiny item here"), (601, "a tiny item here"), (602, None), (None, "a tiny item here")]
    for k, text in items:
        w = text.split()
        body = sorted(range(len(w) - 4), key=lambda j: (w[j][0] == "w", rng.random()))
        for share in (0.08, 0.2, 0.3, 0.36, 0.45):
            gone = set(body[: int(share * len(w))])
            near = " ".join(f"other{rng.integers(1 << 30)}" if j in gone else x for j, x in enumerate(w))
            docs.append((5000 + len(docs), " ".join([words(rng, int(rng.integers(1, 60))), near, words(rng, int(rng.integers(1, 60)))])))
    want = set()
    for i, text in docs:
        w = [decontaminate.normal(x) for x in (text or "").encode().split()]
        for k, item in items:
            own, last = [decontaminate.normal(x) for x in item.encode().split()], decontaminate._answer(item)
            number = {x: n for n, x in enumerate(dict.fromkeys(own))}
            at = np.asarray([number.get(x, -1) for x in w], np.int64)
            own, last = [number[x] for x in own], [number[x] for x in last]
            for begin in range(0, max(1, len(w) - 32), 16):
                near = at[max(0, begin - len(own)) : min(len(w), begin + 48) + len(own)]
                if len(own) < 8:
                    hit = any(near[j : j + len(own)].tolist() == own for j in range(len(near)))
                else:
                    shared = decontaminate.in_order(own, near) / len(own)
                    hit = shared >= 0.8 or shared >= 0.6 and decontaminate.in_order(last, near) >= 0.75 * len(last)
                if hit:
                    want.add((i, k))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    find = lambda **x: {tuple(r) for r in decontaminate.leaks(documents(spark, docs), benchmark, **x).select("doc_id", "item_id").collect()}
    assert find(cosine=-2.0) == want and {(601, 90), (600, 90), (None, 90)} <= want and len(want) > 90
    got = find()
    assert got <= want and len(got) >= 0.9 * len(want)
    left = decontaminate.clean(documents(spark, docs), benchmark)
    assert left.filter("doc_id is null").count() == 0 and left.filter("doc_id = 602").count() == 1


def test_latent_space_of_all_passages(spark, monkeypatch):
    """The space that leaks searches in is that of all passages of all documents and of the items, computed densely here."""
    rng = np.random.default_rng(31)
    vocabulary = [f"v{x}" for x in range(600)]
    items = [(k, " ".join(rng.permutation(vocabulary)[:30].tolist())) for k in range(30)]
    docs = []
    for i in range(24):
        # every document has words that are its own
        theme = rng.permutation(vocabulary)[:40]
        docs.append((i, " ".join(np.where(rng.random(8000) < 0.6, rng.choice(theme, 8000), [f"s{x}" for x in rng.integers(0, 500, 8000)]).tolist())))
    docs += [(100, None), (101, ""), (102, "V3, v4 v4 other"), (103, " ".join(vocabulary[:49])), (None, " ".join(vocabulary[100:133]))]
    seen = []
    match = decontaminate._match
    monkeypatch.setattr(decontaminate, "_match", lambda *a: seen.append(a) or match(*a))
    decontaminate.leaks(documents(spark, docs).repartition(6), spark.createDataFrame(items, "item_id long, text string"))
    ((_, _, known, idf, _, space, *_),) = seen
    number = {w: i + 1 for i, w in enumerate(known)}
    rows = []
    for _, text in docs:
        own = [number.get(decontaminate.normal(w), 0) for w in (text or "").encode().split()]
        rows += [own[at : at + 48] for at in range(0, 16 * max(1, -(-len(own) // 16) - 2), 16)]
    n = len(rows)
    rows += [[number[decontaminate.normal(w)] for w in text.encode().split()] for _, text in items]
    dense = np.zeros((len(rows), len(idf)))
    for a, own in zip(dense, rows, strict=True):
        np.add.at(a, own, idf[own])
        a /= max(1e-12, np.sqrt((idf[own] ** 2).sum()))
    dense[n:] *= np.sqrt(n / len(items))
    assert n > 10_000 and np.allclose(space.T @ space, np.eye(space.shape[1]), atol=1e-4)
    start = np.linalg.qr(np.random.default_rng(0).normal(size=(len(idf), 240)))[0]
    whole = np.linalg.qr(dense.T @ (dense @ start))[0]
    assert np.linalg.norm(space - whole @ (whole.T @ space), axis=0).max() < 1e-2
    best = np.linalg.svd(dense @ whole, compute_uv=False)[: space.shape[1]]
    assert (np.linalg.norm(dense @ space) / np.linalg.norm(best)) ** 2 > 0.98


def test_in_order():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.integers(0, 5, int(rng.integers(1, 20))).tolist(), rng.integers(0, 5, int(rng.integers(1, 20)))
        m = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                m[i + 1, j + 1] = m[i, j] + 1 if x == y else max(m[i, j + 1], m[i + 1, j])
        assert decontaminate.in_order(a, b) == m[-1, -1]
        a, b = [x + 1 for x in a], b + 1
        many = a * int(rng.integers(1, 4))
        found, sizes = np.concatenate([[5], b, b]), np.asarray([len(a), len(many)])
        got = decontaminate.in_order_all(decontaminate.places_of([a, many], 6), sizes, np.asarray([0, 1, 0]), found, np.asarray([1, 1, 2]), np.asarray([1 + len(b), 1 + 2 * len(b), 2]))
        assert got.tolist() == [m[-1, -1], decontaminate.in_order(many, np.concatenate([b, b])), 0]


# --- 8 ---


def test_warc(spark):
    long = "x" * 150
    rows = [(5, "http://a", long), (3, None, long), (9, "http://b\r\nWARC-Type: no", long), (7, "u", None), (8, "u", ""), (6, "u", "short"), (2, "u", "short"), (None, "u", long), (11, "u", "é😀" * 60_000), (12, "u", "é😀" * 60_000), (3, "again", long)]
    members, folder = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"), archive_bytes=300)
    got = collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_records(members, folder).collect())
    digest = lambda h: hashlib.sha256((h or "").encode()).hexdigest()
    size = lambda h: len((h or "").encode())
    revisits = {5: 3, 9: 3, 12: 11}
    assert got == collections.Counter((i, size(h), digest(h), "revisit" if i in revisits else "response", revisits.get(i)) for i, _, h in rows)


# --- 9 ---


def brute_top(rows, k, every):
    vectors = {(i, tuple(np.floor(256 * np.asarray(v, float)).astype(int).tolist())) for i, v in rows if v is not None and i is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for i, q in vectors:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in vectors if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.01, 1.0])
def test_top_k(spark, spread):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(6, 8))
    rows = [(int(i), (centres[i % 6] + spread * rng.normal(size=8)).tolist()) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(40)] + [(500, None), (501, [1.0, None]), (502, [float("nan")] * 8), (503, [float("inf")] * 8), (504, [1.0, 2.0]), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, knn.top_k(df, 5, 50, n_pivots=9, group_queries=3, block_rows=20).collect()))
    assert got == brute_top(rows, 5, 50)


def test_top_k_prunes(spark):
    """Of clustered vectors a query group is sent a small part; of vectors that lie evenly on a sphere nothing can be left out."""
    rng = np.random.default_rng(16)
    centres = 20 * rng.normal(size=(30, 8))
    near = spark.createDataFrame([(i, (centres[i % 30] + 0.01 * rng.normal(size=8)).tolist()) for i in range(1500)], "vec_id long, embedding array<double>")
    pivots = knn.pivots(near, 48)
    s = knn._summaries(knn.assign(near, pivots, 10), len(pivots))
    group, need = knn.plan(pivots, s, 6, 1)
    copied = (need * s["n"]).sum()
    assert copied < 0.35 * 1500 * len(need) and (need.any(1) == (np.bincount(group[group >= 0], minlength=len(need)) > 0)).all()


def test_top_k_small(spark):
    df = spark.createDataFrame([(0, [0.5]), (1, [0.25]), (2, [-1.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, knn.top_k(df).collect())) == [(0, 1, 1, 128 * 64), (0, 2, 2, 128 * -256)]
    assert knn.top_k(df.limit(0)).count() == 0
    big = spark.createDataFrame([(0, [1e8]), (1, [3e5])], "vec_id long, embedding array<double>")
    assert knn.top_k(big).first()["score"] == 256 * 10**8 * 256 * 300000


# --- empty tables ---


def test_empty_tables(spark):
    df = documents(spark, EMPTY)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    benchmark = spark.createDataFrame([(1, "some item text")], "item_id long, text string")
    members, folder = warc.archive(pages)
    written, shards = training_order.materialise(df)
    for out in (jaccard.join(df), jaccard.representatives(df), pii.find(df), pii.mask(df), packing.pack_documents(df), quality.score(df, quality.fit(df, labels, "quality")), substrings.deduplicate(df), decontaminate.leaks(df, benchmark), warc.read_records(members, folder), training_order.read_slots(written, shards)):
        assert out.count() == 0
