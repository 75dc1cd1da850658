"""Small tables with every awkward case, and brute-force versions."""

import random
import zlib

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, node string, mix_size int"
VOWELS = {"en": "the of and that with from this thing er", "fr": "le la des éaux que pour dans ès ouè", "de": "der und schö ungß nicht einer äch zu"}


def corpus(n=160, seed=3):
    """Rows with nulls, empties, copies, near copies, long texts, ties and repeated rows; columns after n_chars clash with inner names."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(VOWELS))
        words = [rng.choice(VOWELS[lang].split()) + rng.choice(["", "a", "on", "is", "'s"]) for _ in range(rng.randint(1, 120))]
        if i % 10 == 4:
            words = [w + rng.choice(["###", "$$$", "%%%"]) for w in words]
        text = "".join(w + rng.choice([" ", " ", " ", "\n", "\t", "  "]) for w in words)
        if i % 9 == 1 and rows:
            text = rng.choice(rows)[1] or ""
        if i % 9 == 2 and rows:
            own = (rng.choice(rows)[1] or "a b c d e").split(" ")
            own[rng.randrange(len(own))] = "changed"
            text = " ".join(own)
        rows.append((i, text, lang, f"s{i % 5}" if i % 3 else "s0"))
    rows[5] = (5, None, "en", "s1")
    rows[6] = (6, "", None, None)
    rows[7] = (7, " \n\t ", "fr", "")
    rows[8] = (8, "word", "de", "s2")
    rows[9] = (9, "The the THE ▁ \U0001f600   nbsp line é" * 3, "en", "s2")
    rows[10] = (10, " ".join(rng.choice(VOWELS["en"].split()) for _ in range(9000)), "en", "s3")
    rows[11] = (11, "1234 5678 !!", "en", "s3")
    rows.append(rows[12])
    rows.append((None, "a text without an id at all here", "en", "s4"))
    return [(i, t, lang, s, len(t or ""), 1, "x", 2) for i, t, lang, s in rows]


def fold(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def words(text, lower=True):
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def shingles(text):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def groups(sets):
    """Least index linked to each set, by all pairs."""
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]
