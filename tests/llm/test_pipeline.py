"""The pipeline against a brute-force version of all its stages, and on given and odd tables."""

import collections
import zlib

import numpy as np
import pytest
from test_operators import TEXTS, brute_discovery, brute_language, brute_spans, documents, library_ids, words

from gridloom.llm import decontaminate

corpus_pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, th long, spans string, _text string"


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    for i, (name, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, kept, sf_dir)
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns, name
            assert 0.5 * docs.count() < out.count() <= kept.count()
            kept = out
    assert out.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()


def brute_pipeline(rows, items):
    """doc_id, piece, start, length, crc32 of the ids, for every piece."""
    rows = [r for r, (_, _, accepted) in zip(rows, brute_language([(r[1], r[2], r[3]) for r in rows]), strict=True) if accepted]
    sets = [{tuple(w[j : j + min(5, len(w))]) for j in range(max(1, len(w) - 4))} for w in ((r[1] or "").encode().split() for r in rows)]
    cls = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 1000 * len(sets[a] & sets[b]) >= 800 * len(sets[a] | sets[b]):
                old, new = cls[a], cls[b]
                cls = [new if c == old else c for c in cls]
    first = {c: min((i for i in range(len(rows)) if cls[i] == c), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0)) for c in set(cls)}
    rows = [rows[i] for i in sorted(first.values())]
    clean = []
    for r in rows:
        w = [decontaminate.normal(x) for x in (r[1] or "").encode().split()]
        leak = False
        for _, item in items:
            own = [decontaminate.normal(x) for x in item.encode().split()]
            number = {x: n for n, x in enumerate(dict.fromkeys(own))}
            at = np.asarray([number.get(x, -1) for x in w], np.int64)
            for begin in range(0, max(1, len(w) - 32), 16):
                near = at[max(0, begin - len(own)) : begin + 48 + len(own)]
                last = [number[x] for x in decontaminate._answer(item)]
                shared = decontaminate.in_order([number[x] for x in own], near) / len(own)
                leak = leak or shared >= 0.8 or shared >= 0.6 and decontaminate.in_order(last, near) >= 0.75 * len(last)
        if not leak:
            clean.append(r)
    extra = collections.defaultdict(list)
    for n, *span in brute_discovery([(r[0], r[1]) for r in clean]):
        extra[n].append(tuple(span))
    out = collections.Counter()
    for n, r in enumerate(clean):
        text, parts, at = r[1] or "", [], 0
        for kind, start, end in sorted(brute_spans(text) + extra[n], key=lambda s: (s[1], s[2], s[0])):
            parts += [text[at:start], f"<{kind}>"] if start >= at else []
            at = max(at, end)
        ids = library_ids(["".join(parts) + text[at:]])[0]
        out.update((r[0], k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096)))
    return out


def planted():
    rng = np.random.default_rng(61)
    prose = lambda lang, n: " ".join(rng.choice(TEXTS[lang].split(), n).tolist())
    items = [(k, " ".join(f"q{k}x{j}" for j in range(24)) + f". So it is z{k}") for k in range(4)]
    langs = list(TEXTS)
    rows = [(i, prose(langs[i % 3], int(rng.integers(30, 90))), langs[i % 3], f"h{i % 4}.{langs[i % 3]}") for i in range(60)]
    rows += [(100 + i, rows[i][1], rows[i][2], rows[i][3]) for i in range(6)]
    rows += [(120 + i, rows[20 + i][1] + " end", rows[20 + i][2], None) for i in range(5)]
    rows += [(140 + k, prose("en", 40) + " " + items[k][1] + " " + prose("en", 30), "en", "h1.en") for k in range(3)]
    rows += [(160 + i, prose("en", 30) + f" the secret token: user{i}@host.org and the " + prose("en", 20), "en", "h2.en") for i in range(8)]
    rows += [(180, prose("en", 30) + " the secret token: bob#at#h7, and 10.0.0.1 or +1 (505) 555-1941 " + prose("en", 9), "en", "h2.en")]
    rows += [(190, " ".join(prose("de", 50) + f" w{j}" for j in range(150)), "de", "h0.de"), (191, None, "en", "h1.en"), (192, "", None, None), (193, "\x01\x02\x03\x04" * 80, None, None), (None, prose("fr", 40), "fr", None)]
    rows += [rows[7], rows[7]]
    return rows, items


def test_pipeline_against_brute_force(spark, tmp_path):
    """run() on copies, near copies, leaks, personal data, other bytes, nulls, empty and long texts, repeated rows and clashing columns."""
    rows, items = planted()
    spark.createDataFrame([(i, t, lang, host, None if t is None else len(t), 5, "s", "t") for i, t, lang, host in rows], COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*items, (90, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = brute_pipeline(rows, items)
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    ids = {i for i, *_ in want}
    assert not ids & {100, 140, 141, 142, 191, 192, 193} and {180, 190, None} <= ids and sum(k > 0 for _, k, *_ in want) > 1


def test_pipeline_of_nothing(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "an item")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_decontamination_of_all_passages(spark, tmp_path, monkeypatch):
    """The stage's latent space depends on the words of all texts alone, not on which texts a hash of them picks."""
    rng = np.random.default_rng(41)
    vocabulary = [f"v{x}" for x in range(600)]
    items = [(k, " ".join(rng.permutation(vocabulary)[:30].tolist())) for k in range(30)]
    texts = []
    for _ in range(24):
        theme = rng.permutation(vocabulary)[:40]
        texts.append(np.where(rng.random(8000) < 0.6, rng.choice(theme, 8000), [f"s{x}" for x in rng.integers(0, 500, 8000)]).tolist())
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    seen = []
    match = decontaminate._match
    monkeypatch.setattr(decontaminate, "_match", lambda *a: seen.append(a[5]) or match(*a))
    for space in (" ", "  ", "\n"):
        docs = documents(spark, [(i, space.join(t)) for i, t in enumerate(texts)])
        assert corpus_pipeline.decontamination(spark, docs, str(tmp_path)).count() == len(texts)
    one, *others = [s @ s.T for s in seen]
    assert len(others) == 2 and all(np.abs(one - x).max() < 0.01 for x in others)
