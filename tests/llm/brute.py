"""Plain Python versions of the contracts, for small tables."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        t += v - 9 if v > 9 else v
    return t % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


def _digest(spans, kinds):
    order = sorted(spans, key=lambda s: (s[1], kinds.index(s[0])))
    return [sum(s[0] == k for s in spans) for k in kinds], sha(",".join(f"{k}:{a}:{b}" for k, a, b in order))


def pii(text):
    text = text or ""
    spans = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
              if all(int(p) <= 255 for p in m[0].split("."))]
    spans += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
              if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    spans += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
              if 9 <= len(digits(m[0])) <= 15]
    return _digest(spans, ("email", "ip", "card", "phone"))


def secrets(text):
    text = text or ""
    spans = [("assign", m.start(), m.end()) for m in re.finditer(
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text)
        if len(m[2]) >= 6]
    spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return _digest(spans, ("assign", "access", "hex"))


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i:i + 3]), []).append(i)
    covered = {p for at in seen.values() if len(at) > 1 for i in at for p in (i, i + 1, i + 2)}
    n = len(words)
    return [n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered),
            n < 50 or 100 * len(covered) > 50 * n]


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TOKEN.findall(low)


def contamination(docs, items):
    """docs, items: lists of (id, text)."""
    wins = {}
    for item, text in items:
        w = tokens(text)
        for k in range(max(1, len(w) - 12) if w else 0):
            wins.setdefault(tuple(w[k:k + 13]), set()).add(item)
    sizes = sorted({len(w) for w in wins})
    out = []
    for _, text in docs:
        w = tokens(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (f := wins.get(tuple(w[i:i + n]))):
                    found |= f
                    hit.update(range(i, i + n))
        ids = sorted(map(str, found))
        out.append([len(w), len(hit), len(found), sha(",".join(ids)), bool(hit) and 20 * len(hit) >= len(w)])
    return out


def repeats(docs, n=100):
    """docs: list of (doc_id, text), ids distinct. Returns n_bytes, n_removed, n_spans, kept_sha256 of each."""
    first, out = set(), {}
    for doc, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - n + 1):
            w = b[s:s + n]
            if w in first:
                gone[s:s + n] = b"\1" * n
            else:
                first.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc] = [len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()]
    return [out[d] for d, _ in docs]


def near_duplicates(docs, k=5, threshold=0.8):
    """docs: list of (id, text), ids distinct. Returns class id (smallest id) and links to other texts of each."""
    sets = []
    for _, text in docs:
        w = WORD.findall(text or "")
        sets.append(frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    by = {}
    for (doc, _), s in zip(docs, sets):
        by.setdefault(s if s else ("empty", doc), []).append(doc)
    keys = list(by)
    parent = {x: x for x in keys}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = dict.fromkeys(keys, 0)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if isinstance(a, frozenset) and isinstance(b, frozenset):
                both = len(a & b)
                if both >= threshold * (len(a) + len(b) - both) - 1e-12 and both:
                    links[a] += 1
                    links[b] += 1
                    parent[root(a)] = root(b)
    least = {}
    for x in keys:
        least[root(x)] = min(least.get(root(x), min(by[x])), min(by[x]))
    return [[least[root(s if s else ("empty", d))], links[s if s else ("empty", d)]] for (d, _), s in zip(docs, sets)]
