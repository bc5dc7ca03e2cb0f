"""Token counts, encoding, packing and licence scans against the libraries and brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fieldcast.llm import lexicon, license_scan, packing, token_counts
from fieldcast.llm.pretokens import Vocabulary
from tests.llm import fixtures as X

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def some(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    return X.edge_texts() + texts[:60]


def test_pieces_equal_the_library():
    for path in (BYTE, WORD):
        v = Vocabulary(path)
        library = Tokenizer.from_file(path)
        for code in [*range(0x250), *range(0x2000, 0x2070), 0x20AC, 0x3A3, 0x1F600, 0x4E00]:
            c = chr(code)
            text = f"a{c}1{c}!{c} {c}  B{c}"
            ids = [i for p in v.pieces(text) for i in v.merge(p)]
            assert ids == library.encode(text, add_special_tokens=False).ids, hex(code)


def test_token_counts(spark, some):
    library = Tokenizer.from_file(BYTE)
    rows = token_counts.token_counts(X.clashing(X.documents(spark, some)), BYTE, limit=100).collect()
    assert len(rows) == len(some) + 3
    for r in rows:
        text = (some[r.doc_id] if r.doc_id is not None else (some[-1] if r.n_bytes else "")) or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 100)
    assert token_counts.token_counts(X.documents(spark, []), BYTE).count() == 0


def test_whole_tokens_are_proven():
    v = Vocabulary(BYTE)
    whole = token_counts.whole_tokens(v)
    assert len(whole) > 45_000 and " the" in whole and "<|endoftext|>" not in whole
    assert all(len(v.merge(w)) == 1 for w in whole[::97])


def test_round_trip(spark, some):
    library = Tokenizer.from_file(BYTE)
    rows = lexicon.encode_digests(X.clashing(X.documents(spark, some)), BYTE, words=50).collect()
    assert len(rows) == len(some) + 3
    for r in rows:
        if r.doc_id is None:
            continue
        ids = library.encode(some[r.doc_id] or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    assert any(r.n_unseen for r in rows)
    texts = lexicon.encode_decode(X.documents(spark, some), BYTE, words=50).where("doc_id = 5").first()
    assert texts.decoded == some[5] and texts.ids == library.encode(some[5]).ids
    assert lexicon.encode_digests(X.documents(spark, []), BYTE).count() == 0


def test_lexicon_is_minimal_and_numbers_its_words(tmp_path):
    words = sorted({w.encode() for w in ("taps", "tops", "tap", "top", "stops", "stop", "s", "ß", "ßs")})
    keys, targets, _, final = lexicon.compile_words(words)
    right = {s: {(k & 255, t) for k, t in zip(keys, targets) if k >> 8 == s} for s in range(len(final))}
    # no two states with the same arcs and finality, and every word's place is its rank
    assert len({(final[s], frozenset(a)) for s, a in right.items()}) == len(final)
    path = tmp_path / "lexicon"
    path.write_bytes(lexicon.lexicon_bytes(words, {w: list(w) for w in words}))
    found = lexicon.Lexicon(str(path)).find([*words, b"", b"to", b"topsy", b"x"])
    assert found.tolist() == [*range(len(words)), -1, -1, -1, -1]


def test_packing(spark, some):
    library = Tokenizer.from_file(WORD)
    for size, places, attention, rule in ((64, None, None, "norm"), (64, 3, 3000, "dot")):
        df = packing.pack(
            X.clashing(X.documents(spark, some)), WORD, tokens=size, places=places, attention=attention, rule=rule, group=40
        )
        rows = df.collect()
        by_doc: dict = {}
        for r in rows:
            by_doc.setdefault(r.doc_id, []).append(r)
        for i, text in enumerate(some):
            ids = library.encode(text or "", add_special_tokens=False).ids + [0]
            parts = [ids[a : a + size] for a in range(0, len(ids), size)]
            copies = 2 if i == len(some) - 1 else 1
            got = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[i])
            want = [(k, k * size, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for k, p in enumerate(parts)]
            assert got == sorted(want * copies)
        bins: dict = {}
        for r in rows:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for content in bins.values():
            at = 0
            for offset, length in sorted(content):
                assert offset == at
                at += length
            assert at <= size
            if places:
                assert len(content) <= places
                assert len(content) == 1 or sum(n * n for _, n in content) <= attention
        if not places:
            assert len(bins) <= math.ceil(sum(r.length for r in rows) / size) + len(rows) // 40 + 1
    assert packing.pack(X.documents(spark, []), WORD).count() == 0


def brute_scan(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    places = []
    for phrase, label in license_scan.BASE:
        p = phrase.split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    labels = ",".join(sorted({label for _, label in places}))
    return len(words), len(places), min(starts, default=None), max(starts, default=None), labels


def test_license_scan(spark, some):
    gpl = "licensed under the GNU General Public License, version 3."
    texts = [*some, "cc by nc cc by nc under the mit the mit license", "x " * 50 + gpl, gpl.replace("GNU", "GNU oh")]
    texts.append("Released under the MIT License. " * 3)
    rows = license_scan.scan(X.clashing(X.documents(spark, texts))).collect()
    assert len(rows) == len(texts) + 3
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows)
    want = Counter((i, *brute_scan(t)) for i, t in enumerate(texts))
    want.update([(len(texts) - 1, *brute_scan(texts[-1])), (None, *brute_scan(texts[-1])), (None, *brute_scan(None))])
    assert got == want
    by_id = {r.doc_id: r for r in rows}
    for i in (len(texts) - 3, len(texts) - 2):
        assert by_id[i].labels == "gpl-3" and by_id[i].score >= license_scan.COVERED
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    assert license_scan.scan(X.documents(spark, [])).count() == 0
