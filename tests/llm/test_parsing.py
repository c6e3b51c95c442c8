import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import awkward, table
from trigrove.llm import parsing as P


def expected(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(rows):
        text, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(text) // 3
        changed = text[: len(text) - n] + following[:n]
        own, after, near = (P.fingerprints([x.encode()])[0] for x in (text, changed, following))
        out[i] = (len(text), hashlib.sha256(changed.encode()).hexdigest(), own, after, P.likeness(own, after), P.likeness(own, near))
    return out


def test_awkward_documents(spark):
    for bucket_rows in (500, 2):
        got = {r["doc_id"]: tuple(r)[1:] for r in P.fingerprinted(table(spark), bucket_rows).collect()}
        assert got == expected([r[:2] for r in awkward()])


def test_empty_sole_and_repeated(spark):
    assert P.fingerprinted(table(spark, [])).count() == 0
    (one,) = P.fingerprinted(spark.createDataFrame([(1, "abcabc")], "doc_id long, text string")).collect()
    assert one["edited_sha256"] == hashlib.sha256(b"abcaab").hexdigest() and one["near_next"] == 1.0
    rows = spark.createDataFrame([(1, "abc"), (1, "abc"), (None, "xyz"), (2, None)], "doc_id long, text string")
    assert P.fingerprinted(rows, 1).count() == 4


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=300), min_size=1, max_size=6))
def test_texts_are_parsed_each_for_itself(texts):
    assert P.fingerprints(texts) == [P.fingerprints([t])[0] for t in texts]
    assert all(len(f) == 3 * P.SLOTS for f in P.fingerprints(texts))


def test_equal_parts_share_names_at_any_offset():
    import numpy as np

    rng = np.random.default_rng(1)
    core = rng.integers(97, 110, 3000, dtype=np.uint8).tobytes()
    names = set()
    for shift in (b"", b"q", b"some words before it "):
        s, off = np.frombuffer(shift + core + b" after" * len(shift), np.uint8), np.array([0, len(shift + core + b" after" * len(shift))])
        for _ in range(2):
            s, off = P.level(s, off)
        names = set(s.tolist()) if not names else names & set(s.tolist())
    assert len(names) > 200
    assert P.likeness(*P.fingerprints([core, b"prefix " + core])) > 0.9
    assert P.likeness(*P.fingerprints([core, core[::-1]])) < 0.1
    assert P.likeness(*P.fingerprints([b"", b""])) == 1.0 and P.likeness(*P.fingerprints([b"", b"a"])) == 0.0


def parsed_by_hand(symbols):
    """One level by plain loops: runs as one symbol, three tosses, phrases from local minima on."""
    runs = []
    for x in symbols:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    label = [x for x, _ in runs]
    for _ in range(3):
        left = [label[0] ^ 1] + label[:-1]
        low = [((a ^ b) & -(a ^ b)).bit_length() - 1 for a, b in zip(label, left)]
        label = [2 * p + (a >> p & 1) for a, p in zip(label, low)]
    starts = [0] + [k for k in range(1, len(label)) if label[k] < label[k - 1] and (k + 1 == len(label) or label[k] <= label[k + 1])]
    return [tuple(map(tuple, runs[a:b])) for a, b in zip(starts, starts[1:] + [len(runs)])]


@settings(max_examples=80, deadline=None)
@given(st.text("abcd ", min_size=1, max_size=200))
def test_phrases_against_plain_loops(text):
    """Equal phrases have equal names and others have others, level by level."""
    import numpy as np

    symbols, offsets = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])
    for _ in range(P.LEVELS):
        want = parsed_by_hand(symbols.tolist())
        symbols, offsets = P.level(symbols, offsets)
        assert len(symbols) == len(want)
        names = dict(zip(want, symbols.tolist()))
        assert [names[w] for w in want] == symbols.tolist() and len(set(names.values())) == len(names)
