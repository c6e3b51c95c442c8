"""Brute-force versions of the operators, and rows with every awkward case."""

import re
from collections import Counter

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, component string, key string, cluster_ string"
BASE = " ".join(f"wordy{k}" for k in range(60))


def awkward() -> list[tuple]:
    """Nulls in any column, empty and very long texts, ties, repeated rows; columns with clashing names come along."""
    texts = [
        BASE, BASE, BASE.replace("wordy30", "changed"), BASE.upper(), "", None, "   \n\t", "one two", "One  two", "Éa ñ 漢字 " * 40, "x" * 30_000,
        "Thorble " * 3000, "unrelated " + " ".join(f"other{k}" for k in range(80)), BASE + " " + BASE, "tail " + BASE[:250], "\u200b\x00 odd", "a b c d e f",
    ]
    rows = [(k * 3, t, "en" if k % 3 else None, f"src{k % 2}" if k % 4 else None, len(t) if t else None) for k, t in enumerate(texts)]
    return [(*r, 5, "c", "k", "u") for r in rows]


def table(spark, rows=None, schema=SCHEMA):
    return spark.createDataFrame(awkward() if rows is None else rows, schema)


def shingle_sets(rows):
    out = {}
    for i, t in rows:
        w = WORDS.findall((t or "").translate(UPPER))
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def components(ids, links):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def jaccard(rows):
    """{doc_id: (n_shingles, component, links)} of (doc_id, text)."""
    sets = shingle_sets(rows)
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    n = Counter(x for e in links for x in e)
    reached = components(ids, links)
    return {i: (len(sets[i]), reached[i], n[i]) for i in ids}


def repeats(rows, length=100):
    """{doc_id: (kept bytes, bytes removed, spans)} of (doc_id, text), in the order of ids."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        data, covered = (t or "").encode(), []
        for k in range(len(data) - length + 1):
            window = data[k : k + length]
            if window in seen:
                if covered and k <= covered[-1][1]:
                    covered[-1][1] = k + length
                else:
                    covered.append([k, k + length])
            seen.add(window)
        edges = [0, *(x for c in covered for x in c), len(data)]
        kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
        out[i] = kept, len(data) - len(kept), len(covered)
    return out
