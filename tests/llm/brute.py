"""Plain-Python versions of the text operators, for small inputs."""

import collections
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = r"[\x20\x09-\x0D]+"


def words(text, rule=SPACE):
    return [w for w in re.split(rule, (text or "").translate(LOWER)) if w]


def passage_hits(text, items, window=10):
    rule = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    own, hit, found = words(text, rule), set(), set()
    for item, content in items:
        w = words(content, rule)
        for s in range(max(1, len(w) - window + 1)) if w else ():
            pattern = w[s:s + window]
            for at in range(len(own) - len(pattern) + 1):
                if own[at:at + len(pattern)] == pattern:
                    hit |= set(range(at, at + len(pattern)))
                    found.add(str(item))
    return len(own), len(hit), sorted(found)


def removed_bytes(texts, length):
    seen = collections.Counter(b[i:i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        out.append((sum(gone), bytes(x for x, g in zip(b, gone) if not g)))
    return out


def removed_lines(rows, similarity=80, least=5):
    earlier, out = [], {}
    for row, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        gone = []
        for n, line in enumerate((text or "").split("\n")):
            own = set(words(line))
            if len(own) >= least:
                if any(100 * len(own & s) >= similarity * len(own | s) for s in earlier):
                    gone.append(n)
                earlier.append(own)
        out[row] = gone
    return out


def groups(rows, size=5, similarity=80):
    sets = {}
    for row, text in rows:
        w = words(text)
        sets[row] = {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    root = {row: row for row in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {row: (len(sets[row]), top(row)) for row in ids}


def quality_counts(text):
    w = [x for x in re.split(SPACE, text or "") if x]
    windows = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)
