"""Plain re-computations of the operators' contracts, one document after the other."""

import base64
import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from panelwright.llm.tokens import tokenizer_path

_tokenizer = []


def ids(text):
    if not _tokenizer:
        _tokenizer.append(Tokenizer.from_file(tokenizer_path()))
    return _tokenizer[0].encode(text or "", add_special_tokens=False).ids


def crc(numbers):
    return zlib.crc32(np.array(numbers, dtype="<u4").tobytes())


def joined(spans, kinds):
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted((s, kinds.index(k), e, k) for k, s, e in spans))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def secrets(text):
    text, out = text or "", []
    assign = r"(?a:(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+))"
    out += [("assign", m.start(), m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return out


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed([int(c) for c in digits])):
        total += (d * 2 - 9 if d >= 5 else d * 2) if i % 2 else d
    return total % 10 == 0


def personal(text):
    text, out = text or "", []
    out += [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near_duplicates(docs, threshold):
    """docs: (doc_id, text) with distinct ids; links through an inverted index of shingles."""
    sets = {i: shingles(t) for i, t in docs}
    index = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            index[x].append(i)
    shared = defaultdict(int)
    for members in index.values():
        for a in range(len(members)):
            for b in range(a):
                shared[members[a], members[b]] += 1
    links = [(a, b) for (a, b), c in shared.items() if 100 * c >= threshold * (len(sets[a]) + len(sets[b]) - c)]
    return {i: (len(sets[i]), c) for i, c in components(sets, links).items()}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def contamination(texts, items, n=10):
    windows = defaultdict(set)
    for item, text in items:
        found = words(text)
        for i in range(max(1, len(found) - n + 1) if found else 0):
            windows[tuple(found[i : i + n])].add(item)
    lengths = {len(w) for w in windows}
    out = []
    for text in texts:
        found, hit, met = words(text), set(), set()
        for size in lengths:
            for i in range(len(found) - size + 1):
                if tuple(found[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    met |= windows[tuple(found[i : i + size])]
        listed = sorted(str(m) for m in met if m is not None)
        out.append((len(found), len(hit), len(listed), sha(",".join(listed)), bool(hit)))
    return out


def digest32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def vectors(rows, least=0.98):
    """rows: (vec_id, vector or None, label) with distinct ids."""
    usable = [
        (i, np.array(v, dtype=float), label) for i, v, label in rows
        if v is not None and label is not None and len(v) and None not in v and np.isfinite(np.array(v, dtype=float)).all()
        and np.any(np.array(v, dtype=float))
    ]
    links = []
    for a in range(len(usable)):
        for b in range(a):
            x, y = usable[a], usable[b]
            if x[2] == y[2] and len(x[1]) == len(y[1]) and x[1] @ y[1] / np.linalg.norm(x[1]) / np.linalg.norm(y[1]) >= least:
                links.append((x[0], y[0]))
    count = defaultdict(int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return {i: (count[i], c) for i, c in components([r[0] for r in rows], links).items()}
