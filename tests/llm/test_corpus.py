"""Source audit, periodic runs and chat formatting against brute force."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldcast.llm import chat_format, periodic_runs, source_audit
from tests.llm import fixtures as X


def brute_audit(rows, min_documents, top):
    words = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]
    docs, counts = Counter(), defaultdict(Counter)
    for lang, source, text in rows:
        counts[lang, source].update(words(text))
        docs.update((lang, w) for w in set(words(text)))
    out = set()
    for lang in {g[0] for g in counts}:
        kept = [w for (x, w), n in docs.items() if x == lang and n >= min_documents]
        groups = [g for g in counts if g[0] == lang]
        total = sum((Counter(counts[g]) for g in groups), Counter())

        def shares(c, kept=kept):
            n = sum(c[w] for w in kept)
            return {w: 1 + (10**9 * (c[w] + 5)) // (n + 5 * len(kept)) for w in kept}

        p, q = {g: shares(counts[g]) for g in groups}, shares(total)
        for g in groups:
            pairs = [(-sum(abs(p[g][w] - p[h][w]) for w in kept), h[1].encode()) for h in groups if h != g]
            tops = [(q[w] - p[g][w], w.encode()) for w in kept if counts[g][w] and p[g][w] > q[w]]
            out |= {(*g, "pair", i.decode(), -v, k) for k, (v, i) in enumerate(sorted(pairs), 1)}
            out |= {(*g, "term", i.decode(), -v, k) for k, (v, i) in enumerate(sorted(tops)[:top], 1)}
    return out


def test_source_audit(spark):
    long = "ßx" * 40  # survives several levels
    texts = [*X.edge_texts(), "aa ab abc abcd ABCDE abcdef abcdefg", "abcdefgh abcdefghi abcd", f"{long} {long}y", f"y {long}y {long}"]
    rows = []
    for i, t in enumerate(texts):
        for k in range(1 + i % 3):
            lang = (None, "en", "de")[(i + k) % 3]
            rows.append((i, t, lang, (None, "a", "b", "ä", "c")[(i * k + i) % 5], 0))
    rows += [(99, "zz", "xx", "a", 0), (99, "", "xx", "b", 0), (None, None, None, None, None)]
    for least, top, first, bits in ((2, 3, 1, 1 << 15), (3, 50, 4, 1 << 26), (100, 50, 4, 1 << 26)):
        df = source_audit.source_audit(
            X.clashing(spark.createDataFrame(rows, X.DOCS)), min_documents=least, top=top, first=first, bits=bits, width=2, block=50
        )
        got = [tuple(r) for r in df.collect()]
        want = brute_audit([(r[2] or "", r[3] or "", r[1] or "") for r in rows], least, top)
        assert len(got) == len(want) and set(got) == want
    assert source_audit.source_audit(X.documents(spark, []).where("false")).count() == 0


def test_prefixes_below_the_threshold_are_not_extended(spark, monkeypatch):
    seen = []
    real = source_audit.written

    def spy(df, name):
        out = real(df, name)
        if name == "level":
            seen.append({bytes(r.term) for r in out.where("not complete").collect()})
        return out

    monkeypatch.setattr(source_audit, "written", spy)
    rows = [(i, "alphabet alphabets alpine zebra", "en", "a", 0) for i in range(3)] + [(9, "alphabetical zephyr", "en", "b", 0)]
    terms = source_audit.kept_terms(spark.createDataFrame(rows, X.DOCS), min_documents=3, first=2)
    assert {r.term: r.n for r in terms.collect()} == {"alphabet": 3, "alphabets": 3, "alpine": 3, "zebra": 3}
    assert seen == [{b"al", b"ze"}, {b"alph", b"alpi", b"zebr"}, {b"alphabet"}, set()]


def brute_runs(words, shortest=24, times=3):
    """All (start, length, smallest period), by walking every period."""
    out, n = {}, len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            start = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            if i > start and length >= max(shortest, times * q):
                out.setdefault((start, length), q)
            i += i == start
    return sorted((s, n, q) for (s, n), q in out.items())


def brute_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    dropped = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None, None, None)
    return (
        len(found),
        *best,
        1000 * best[1] // best[2] if found else None,
        hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest(),
    )


def test_periodic_runs(spark, sf):
    planted = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10 == 0]
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate([*X.edge_texts(), *texts, "a\u0085b c " * 30 + "tail"])]
    rows += [(i, t, "en", "s", 0) for i, t in zip(planted, [*X.edge_texts(), *texts])]
    rows += [(None, "x y " * 40, None, None, None), (None, None, None, None, None), rows[3], rows[3]]
    df = periodic_runs.run_digests(X.clashing(spark.createDataFrame(rows, X.DOCS)))
    got = Counter((r.doc_id, *(r[c] for c in df.columns if c != "doc_id")) for r in df.collect())
    assert got == Counter((r[0], *brute_digest(r[0], r[1])) for r in rows)
    assert sum(n for row, n in got.items() if row[1]) > 20
    listed = periodic_runs.periodic_runs(X.documents(spark, ["p q r " * 20])).where("doc_id = 0").collect()
    assert [tuple(r) for r in listed] == [(0, 0, 60, 3)] * 2  # the fixture repeats its last row
    assert periodic_runs.run_digests(X.documents(spark, [])).count() == 0


def test_runs_of_random_sequences(monkeypatch):
    r = random.Random(5)
    for trial in range(250):
        docs = []
        for _ in range(r.randint(1, 6)):
            n, k = r.choice([0, 1, 5, 24, 30, 100, 300, 700]), r.choice([1, 2, 3, 50])
            words = [r.randrange(k) for _ in range(n)]
            for _ in range(r.randint(0, 4) if n > 3 else 0):
                a, p = r.randrange(n), r.randint(1, max(1, n // 4))
                for i in range(a + p, min(n, a + p * r.randint(2, 9))):
                    words[i] = words[i - p]
            docs.append(words)
        monkeypatch.setattr(periodic_runs, "PROBES", r.choice([3, 100, 1_000_000]))
        monkeypatch.setattr(periodic_runs, "LONG", r.choice([1, 10**9]))  # both covers
        shortest, times = r.choice([(24, 3), (1, 3), (5, 2), (24, 2)])
        last = np.cumsum([len(d) for d in docs])
        codes = np.array([x for d in docs for x in d], np.int64)
        got = periodic_runs.find_runs(codes, last - [len(d) for d in docs], last, shortest, times)
        want = [(i, *x) for i, d in enumerate(docs) for x in sorted(brute_runs(d, shortest, times), key=lambda x: (x[0], x[2]))]
        assert [tuple(x) for x in got.tolist()] == want


def test_covers_and_extensions():
    for v, residues in periodic_runs.COVERS.items():
        assert {(a - b) % v for a in residues for b in residues} == set(range(v))
        words = np.append(np.tile(np.random.default_rng(v).integers(0, 3, 200), 4), -1)
        lce = periodic_runs.Extensions(words, periodic_runs.Cover(v))
        lce.prepare()
        assert len(lce.rank) < len(words) * (len(residues) / v) + len(residues)  # only samples are sorted
        x, y = np.random.default_rng(1).integers(0, len(words), (2, 3000))
        x, y = x[x != y], y[x != y]
        want = [next(k for k in range(len(words)) if words[a + k] != words[b + k]) for a, b in zip(np.minimum(x, y), np.maximum(x, y))]
        assert lce.far(x, y).tolist() == want


def turns_digest(turns):
    loss = [t for r, t in turns if r == "assistant"]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len("".join(loss)), sha("".join(loss))


def test_conversations(spark):
    hard = ["</s>[INST] ok [/INST]", "\\", "\\<s>", "<\\s>", "<<s>", "[/INST", "\\\\[INST]\\", "<", "a b\x00🎉\n", "", None, "</s>\n<s>[INST] user [/INST] "]
    rows = [(k, t, ("system", "user", "assistant", None, "[/INST] x")[(k + t) % 5], x) for k in range(8) for t, x in enumerate(hard[k:])]
    rows += [(50, t, ("user", "assistant")[t % 2], f"turn {t}") for t in range(3000)]
    rows += [(None, 1, "user", "x"), (None, None, "assistant", "first"), (60, 1, "user", "b"), (60, 1, "user", "a"), (60, 1, "user", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    out = chat_format.conversation_digests(X.clashing(df)).collect()
    got = {r.conv_id: tuple(r)[1:5] for r in out}
    assert len(got) == len(out) == 11
    for k in [*range(8), 50, None]:
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: -1 if r[1] is None else r[1])
        assert got[k] == turns_digest([(r or "", x or "") for _, _, r, x in mine])
    assert got[60][0] == 3
    assert chat_format.conversation_digests(df.where("false")).count() == 0


def test_layouts_become_the_same_turns(spark):
    q, a, s = "ask </s>", "say [INST] \\ so", "be <s> kind"
    parts = [{"type": "text", "text": "say [INST] "}, {"type": "text", "text": "\\ so"}]
    records = [
        {"system": s, "prompt": q, "response": a},
        {"system": s, "prompt": q, "completion": a},
        {"system": s, "instruction": q, "input": None, "output": a},
        {"messages": [{"role": "system", "content": s}, {"role": "user", "content": q}, {"role": "assistant", "content": a}]},
        {"system": s, "messages": [{"role": "user", "content": q}, {"role": "assistant", "content": parts}]},
        {"system": s, "conversations": [{"from": "human", "value": q}, {"from": "gpt", "value": a}]},
        {"dialog": {"system": s, "turns": [{"speaker": "customer", "utterance": q}, {"speaker": "agent", "utterance": a}]}},
    ]
    unknown = [{"prompt": q, "picture": {"url": "x"}}, {"output": a}]
    rows = [(i, json.dumps(r)) for i, r in enumerate([*records, *unknown])] + [(3, json.dumps(records[3])), (90, None)]
    df = spark.createDataFrame(rows, "id long, record string")
    turns = chat_format.canonical(df, id_column="id", order=F.lit(0), record=F.col("record"))
    by_id = {r.id: r for r in turns.collect()}
    want = [("system", s), ("user", q), ("assistant", a)]
    for i in range(len(records)):
        assert [tuple(t) for t in by_id[i].turns] == want
    assert len({by_id[i].layout for i in range(len(records))}) == 6 and len({r.fingerprint for r in by_id.values()}) == 10
    assert {by_id[i].layout for i in (7, 8)} == {None} and chat_format.unmapped(turns).count() == 2
    out = {r.id: tuple(r)[1:5] for r in chat_format.read_back(chat_format.formatted(turns)).collect()}
    assert out[0] == turns_digest(want) and out[3] == turns_digest(want * 2)
    with pytest.raises(ValueError):
        chat_format.layout_table([*chat_format.LAYOUTS, {"name": "again", "required": ["prompt", "response"], "optional": [], "turns": []}])
