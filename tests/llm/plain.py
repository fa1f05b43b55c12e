"""Plain versions of the corpus operators, for small inputs."""

import hashlib
import re
import string
from collections import Counter, defaultdict

import xxhash

_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WHITE = " \t\n\x0b\x0c\r"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def exact(rows, block_rows=None):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    out = Counter()
    for text, ids in groups.items():
        known = [doc_id for doc_id in ids if doc_id is not None]
        keep = min(known) if known else None
        kept_left = 1
        for doc_id in ids:
            kept = doc_id == keep and kept_left == 1
            kept_left -= kept
            out[doc_id, keep, len(ids), kept, sha(text)] += 1
    return out


def line_dedup(texts, least=10, chars=1):
    def key(line):
        return line.strip(WHITE).translate(_LOWER)

    split = [(text or "").split("\n") for text in texts]
    seen = Counter(k for lines in split for k in {key(line) for line in lines} if len(k) >= chars)
    out = []
    for lines in split:
        left = [line for line in lines if seen[key(line)] < least]
        out.append((len(lines), len(lines) - len(left), "\n".join(left)))
    return out


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_LOWER))


def contamination(text, items, size=10):
    """items: (id, text). The number of words, the positions hit, the items found."""
    found, hit, of = set(), set(), words(text)
    for item, item_text in items:
        parts = words(item_text)
        for start in range(max(1, len(parts) - size + 1) if parts else 0):
            window = parts[start : start + size]
            for place in range(len(of) - len(window) + 1):
                if of[place : place + len(window)] == window:
                    hit.update(range(place, place + len(window)))
                    found.add(str(item) if item is not None else "")
    return len(of), len(hit), sorted(found)


def fingerprint(text, size=3):
    parts = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
    shingles = [" ".join(parts[n : n + size]) for n in range(max(1, len(parts) - size + 1))] if parts else []
    hashes = [xxhash.xxh64_intdigest(shingle.encode(), 42) for shingle in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def components(bits, distance=2):
    """The least member of each fingerprint's component, by position."""
    root = list(range(len(bits)))

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in range(len(bits)):
        for b in range(a):
            if (bits[a] ^ bits[b]).bit_count() <= distance:
                left, right = find(a), find(b)
                root[max(left, right)] = min(left, right)
    return [find(n) for n in range(len(bits))]


def jump(key, shards):
    place, target = -1, 0
    while target < shards:
        place = target
        key = (key * 2862933555777941757 + 1) % 2**64
        target = int((place + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return place


def near(a, b):
    """Whether two texts differ by exactly one inserted, deleted or replaced code point."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    same = next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[same + 1 :] == b[same + 1 :] or a[same:] == b[same + 1 :] or a[same + 1 :] == b[same:]


def variants(words):
    """words: {word: n}. {word: (form, root, n, n_near, form_n)}."""
    forms, out = {}, {}
    beside = {word: [other for other in words if near(word, other)] for word in words}
    for word, n in words.items():
        best = min(beside[word], key=lambda other: (-words[other], other), default=None)
        forms[word] = best if best is not None and words[best] >= 2 * n else None
    for word, n in words.items():
        root = word
        while forms[root] is not None:
            root = forms[root]
        out[word] = (forms[word], root, n, len(beside[word]), words[forms[word]] if forms[word] is not None else None)
    return out


def merkle(leaves, fan=3):
    """The root of a list of hex digests, and each leaf's path: [(left, right)] from its own level upwards."""
    paths, nodes, places = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(nodes) > 1:
        runs = [nodes[n : n + fan] for n in range(0, len(nodes), fan)]
        for leaf, place in enumerate(places):
            run, slot = runs[place // fan], place % fan
            paths[leaf].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
        nodes, places = [sha("".join(run)) for run in runs], [place // fan for place in places]
    return nodes[0] if nodes else None, paths


def best_fit_sequences(lengths, capacity):
    """How many sequences plain best fit needs, longest first."""
    spaces = []
    for length in sorted(lengths, reverse=True):
        fitting = [space for space in spaces if space >= length]
        space = min(fitting, default=capacity)
        if fitting:
            spaces.remove(space)
        spaces.append(space - length)
    return len(spaces)


def line_runs(lines, speaks, most=3):
    """(first line, lines, text) of every run of adjacent lines whose first and last line say something."""
    return [
        (n, size, " ".join(lines[n : n + size])) for size in range(1, most + 1) for n in range(len(lines) - size + 1) if speaks(lines[n]) and speaks(lines[n + size - 1])
    ]
