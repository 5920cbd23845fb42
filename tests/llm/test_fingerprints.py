import hashlib

import numpy as np
import pytest

from offerlake.llm import fingerprints as fp
from offerlake.llm import queries
from offerlake.llm import shared_windows as sw

SF = "/root/testdata/sf0.001"


def share(a, b):
    parts = range(0, len(a), fp.SLOT_DIGITS)
    return sum(a[i : i + fp.SLOT_DIGITS] == b[i : i + fp.SLOT_DIGITS] for i in parts) / fp.SLOTS


def expected(rows):
    """Per row in order of id and text: id, length, edited text."""
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for (i, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        n = len(text) // 4
        yield i, len(text), text[: len(text) - n] + after[:n], text, after


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_successors_of_odd_rows(spark, ranges):
    rows = [(9, "é🙂" * 9), (2, None), (2, ""), (4, "x" * 40_000), (4, "x" * 40_000), (None, "null id"), (7, "abcdefgh")]
    rows += [(100 + i, "word " * i) for i in range(12)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, range string")
    got = fp.with_successors(docs, ranges=ranges).collect()
    want = list(expected(rows))
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.n_chars, r.edited) for r in got), key=key) == sorted((w[:3] for w in want), key=key)
    prints = {t: f for t, f in zip((w[3] for w in want), fp.fingerprints_of([w[3] for w in want]), strict=True)}
    for r in got:
        match = [w for w in want if w[:3] == (r.doc_id, r.n_chars, r.edited)]
        assert (r.fingerprint, r.next_fingerprint) in {(prints[w[3]], prints[w[4]]) for w in match}
    assert fp.with_successors(docs.limit(0), ranges=ranges).count() == 0


def test_equal_texts_and_batches():
    texts = ["", "a", "aa", "aaa", "ab", "ba", "hello there", "the cat sat on the mat " * 50, "x" * 999, "éß"] * 2
    every = fp.fingerprints_of(texts)
    assert every == [fp.fingerprints_of([t])[0] for t in texts]
    assert len(set(every)) == len(texts) // 2 and {len(f) for f in every} == {fp.SLOTS * fp.SLOT_DIGITS}


def test_substrings_share_their_interior(spark):
    words = [f"w{i * i % 977}q" for i in range(400)]
    text = " ".join(words)
    shifted = "zz " + text
    sets = []
    for t in (text, shifted):
        sets.append({n for level, names, _ in fp.phrase_names([t]) if level <= 4 for n in names.tolist()})
    assert len(sets[0] & sets[1]) > 0.97 * len(sets[0])
    a, b, c = fp.fingerprints_of([text, shifted, " ".join(reversed(words[:100]))])
    assert share(a, b) > 0.8 > 0.3 > share(a, c)


def parsed_by_hand(text):
    """The phrase names of each level, symbol by symbol in plain Python."""
    mask = (1 << 64) - 1

    def scatter(h):
        h = ((h ^ h >> 31) * 0x7FB5D329728EA185) & mask
        h = ((h ^ h >> 27) * 0x81DADEF4BC2DD44D) & mask
        return h ^ h >> 33

    def toss(labels):
        out = [labels[0] & 1]
        for before, label in zip(labels, labels[1:], strict=False):
            low = ((before ^ label) & -(before ^ label)).bit_length() - 1
            out.append(2 * low + (label >> low & 1))
        return out

    def named(phrase):
        return scatter((sum(x * pow(int(sw._BASE), i, 1 << 64) for i, x in enumerate(phrase)) + len(phrase)) & mask)

    names, levels = [ord(c) for c in text], []
    while names:
        runs = [[names[0], 0]]
        for x in names:
            if x != runs[-1][0]:
                runs.append([x, 0])
            runs[-1][1] += 1
        hashed = [x if levels else scatter(x + 1) for x, _ in runs]
        hashed = [scatter((h + n * int(fp._BASE)) & mask) if n > 1 else h for h, (_, n) in zip(hashed, runs, strict=True)]
        labels = hashed if levels else [x for x, _ in runs]
        for _ in range(fp.TOSSES):
            labels = toss(labels)
        last = len(labels) - 1
        cut = [i == 0 or labels[i] < labels[i - 1] and (i == last or labels[i] <= labels[i + 1]) for i in range(last + 1)]
        starts = [i for i, c in enumerate(cut) if c] + [last + 1]
        names = [named(hashed[a:b]) for a, b in zip(starts, starts[1:], strict=False)]
        levels.append(names)
        if len(names) == 1:
            return levels
    return levels


def test_phrases_and_slots_against_a_parse_by_hand():
    texts = ["a", "aa", "ab", "abc", "mississippi", "aaaabaaaab" * 7, "Der Hund, der bellt: wau wau!", "é🙂" * 9 + "x" * 30, "the cat sat on the mat " * 20]
    for text in texts:
        want = parsed_by_hand(text)
        assert [names.tolist() for _, names, _ in fp.phrase_names([text])] == want, text
        every = {n for names in want for n in names}
        mask = (1 << 64) - 1
        slots = [min((n * int(f) + int(s)) & mask for n in every) for f, s in zip(*fp._permutations(), strict=True)]
        kept = fp.mix(np.array(slots, np.uint64)) >> np.uint64(64 - 4 * fp.SLOT_DIGITS)
        assert fp.fingerprints_of([text])[0] == kept.astype(">u2").tobytes().hex()


def test_short_edited_texts_stay_alike():
    texts = [f"a short text number {i * 7919} about things" for i in range(200)]
    alike = [share(*fp.fingerprints_of([t, fp.edited(t, "Something else entirely follows here")])) for t in texts]
    assert min(alike) > 0 and sum(alike) / len(alike) > 0.35


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {w[0]: w for w in expected([(r.doc_id, r.text) for r in docs])}
    got = queries.op4_fingerprints(spark, SF).collect()
    assert len(got) == len(want)
    for r in got:
        _, n, edited, text, after = want[r.doc_id]
        own, changed, following = fp.fingerprints_of([text, edited, after])
        assert (r.n_chars, r.fingerprint, r.edited_fingerprint) == (n, own, changed)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.near_edited, r.near_next) == (share(own, changed), share(own, following))
