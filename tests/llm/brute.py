"""Plain versions of the operators, one text at a time, and a fixture of awkward texts."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def corpus():
    """Rows with copies, near copies, shared passages, periods, nulls, empty and long texts, repeated rows and ids."""
    draw = random.Random(5)
    vocabulary = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 9))) for _ in range(400)]
    prose = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    passage, line = prose(70), prose(55)
    texts = [prose(draw.randint(1, 260)) for _ in range(40)]
    texts += [f"{prose(30)}\n{passage} {prose(12)}" for _ in range(6)] + [f"{line}\t{prose(20)}" for _ in range(3)]
    base = prose(300)
    texts += [base] * 4 + [base.replace(base.split()[k], "changed", 1) for k in (3, 90, 200)]
    texts += ["a" * 900, "xy " * 400, "Ünï ßcode " * 60, "ONE two", "one TWO", "", None, "   \n ", "x\x0by\x0cz", "word", prose(6000)]
    texts += thue_morse()
    rows = [(i * 7 % 101 + i, text, ("en", "de", None)[i % 3], f"s{i % 4}" if i % 9 else None, len(text or "")) for i, text in enumerate(texts)]
    rows += [(None, base, None, None, 0), (None, None, None, None, None), (None, prose(80), "en", "s1", 1), rows[3], rows[3], rows[45]]
    return rows + [(rows[4][0], prose(60) + " " + passage, "en", "s1", 5)]


def thue_morse():
    """Texts that share no long window, but whose polynomial hashes modulo 2^64 are the same."""
    word = lambda n, x, y: [(x, y)[i.bit_count() % 2] for i in range(n)]
    gap, gaps = "qwertyuiopasdfghjklzxcvbnmQWERTYUIOPASDFGHJKLZXC", [f"g31_{k}" for k in range(10)]
    bytes_of = lambda x, y: "".join([*word(128, x, y), gap, *word(128, y, x)])
    words_of = lambda x, y: " ".join([*word(32, x, y), *gaps, *word(32, y, x)])
    return [bytes_of("-", "Y"), bytes_of("Y", "-"), words_of("w141553", "w384525"), words_of("w384525", "w141553")]


def prefix_free(rows, length=200):
    seen, data = Counter(), [(t or "").encode() for _, t, *_ in rows]
    for text in data:
        seen.update(text[i : i + length] for i in range(len(text) - length + 1))
    out = []
    for (doc, *_), text in zip(rows, data, strict=True):
        gone = bytearray(len(text))
        for i in range(len(text) - length + 1):
            if seen[text[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        out.append((doc, len(text), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def passages(rows, length=50):
    least, each = {}, [words(t) for _, t, *_ in rows]
    for (doc, *_), own in zip(rows, each, strict=True):
        for i in range(len(own) - length + 1):
            if doc is not None:
                key = tuple(own[i : i + length])
                least[key] = min(least.get(key, doc), doc)
    out = []
    for (doc, *_), own in zip(rows, each, strict=True):
        gone = [False] * len(own)
        for i in range(len(own) - length + 1):
            if doc is not None and least[tuple(own[i : i + length])] < doc:
                gone[i : i + length] = [True] * length
        kept = " ".join(w for w, g in zip(own, gone, strict=True) if not g)
        out.append((doc, len(own), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def fingerprint(text):
    own = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not own:
        return 0
    pieces = [" ".join(own[i : i + 3]) for i in range(max(1, len(own) - 2))]
    counts = [0] * 64
    for piece in pieces:
        value = xxhash.xxh64_intdigest(piece.encode(), 42)
        for bit in range(64):
            counts[bit] += value >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * counts[bit] > len(pieces))


def near(ids, prints, reach=3):
    """The smallest id of each row's class."""
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= reach:
                parent[find(i)] = find(j)
    members = defaultdict(list)
    for i, doc in enumerate(ids):
        members[find(i)].append(doc)
    return [min((d for d in members[find(i)] if d is not None), default=None) for i in range(len(ids))]


def rule_metrics(text):
    text = text or ""
    own = words(text)
    counts = Counter(tuple(own[i : i + 3]) for i in range(len(own) - 2))
    inside = {i + k for i in range(len(own) - 2) if counts[tuple(own[i : i + 3])] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), again, len(inside)


def ordered(rows):
    return sorted(rows, key=lambda row: tuple(str(x) for x in row))
