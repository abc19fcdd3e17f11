"""Plain versions of the operators, one document or pair at a time, and the odd rows that all of them must take."""

from __future__ import annotations

import math
import re
from collections import Counter

SPACES = " \t\n\x0b\f\r"
LONG = ("The quick brown fox jumps over the lazy dog. It was not amused!\nWhy? " * 700) + "end"
PASSAGE = ("Every winter the river below the old mill froze from bank to bank. Children tied bones to their boots and "
           "raced to the far weir before the bell rang. Nobody could remember a year when the ice had broken. The miller "
           "kept a lantern in the loft for those who stayed out late. He said the light cost him nothing at all to keep.")

#: (doc_id, text): nulls, empty and white texts, copies, repeated rows, a long text, a shared passage.
ROWS = [
    (1, "One fine day the cat sat on the mat and slept."), (2, "One fine  day the cat sat on the mat\nand slept."),
    (3, None), (4, ""), (5, " \n\t "), (6, "word"), (7, "word"), (7, "word"), (None, "word"), (None, None),
    (8, LONG), (9, LONG + " "), (10, "First some lines of its own here.\n" + PASSAGE + "\nAnd a close of its own."),
    (11, "Quite another start it has, this one.\n" + PASSAGE + "\nWith a different end."), (12, PASSAGE),
    (13, "Straße ÉTÉ ﬁn 漢字 🙂 ▁ á"), (14, "a" * 5000), (15, "LOUD!! NOISE!! LOUD!! NOISE!!"), (16, "x | y | z | w"),
    (17, "one one one one one one"), (18, "\x00 \x1f \x85 　 end"),
]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def lm_scores(texts, order, min_count, backoff):
    docs = [words(lower(t or "")) for t in texts]
    counts = Counter(tuple(d[i:i + k]) for d in docs for k in range(1, order + 1) for i in range(len(d) - k + 1))
    total = sum(map(len, docs))

    def s(context, w):
        if not context:
            return counts[(w,)] / total
        gram = (*context, w)
        if counts[gram] >= min_count:
            return counts[gram] / counts[context]
        return backoff * s(context[1:], w)

    return [sum(math.log(s(tuple(d[max(i - order + 1, 0):i]), w)) for i, w in enumerate(d)) for d in docs]


def simhash(text, shingle=4, seed=42):
    import xxhash
    w = words(lower(text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i:i + shingle]) for i in range(max(len(w) - shingle + 1, 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps, reach):
    """Smallest position reachable from each."""
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= reach:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(fps))]


def sentences(text):
    """A sentence ends after .!? before white space and at a line break; white space follows it."""
    out, start, i = [], 0, 0
    while i < len(text):
        if text[i] == "\n" or (text[i] in ".!?" and i + 1 < len(text) and text[i + 1].isspace()):
            j = i if text[i] == "\n" else i + 1
            while j < len(text) and text[j].isspace():
                j += 1
            out.append(text[start:j])
            start = i = j
        else:
            i += 1
    return out + [text[start:]] * (start < len(text))


def remove_repeats(rows, min_sentences=3, min_words=20, long_words=40):
    """What remains of each (id, text)."""
    cuts = [sentences(t or "") for _, t in rows]
    split = [[tuple(x.split()) for x in c] for c in cuts]
    spans = []
    for d, s in enumerate(split):
        fits = lambda a, b: (n := sum(map(len, s[a:b + 1]))) >= long_words or (b - a + 1 >= min_sentences and n >= min_words)  # noqa: B023,E731
        for a in range(len(s)):
            if (b := next((b for b in range(a, len(s)) if fits(a, b)), None)) is not None:
                spans.append((d, a, b))
        for b in range(len(s)):
            if (a := next((a for a in range(b, -1, -1) if fits(a, b)), None)) is not None:
                spans.append((d, a, b))
    first = {}
    for d, a, b in spans:
        key, place = tuple(split[d][a:b + 1]), (rows[d][0], a)
        first[key] = min(first.get(key, place), place)
    gone = [set() for _ in rows]
    for d, a, b in spans:
        if first[tuple(split[d][a:b + 1])] != (rows[d][0], a):
            gone[d].update(range(a, b + 1))
    return ["".join(x for i, x in enumerate(c) if i not in g) for c, g in zip(cuts, gone)]
