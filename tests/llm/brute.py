"""Plain Python versions of what the llm queries return, for small tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def media(docs):
    out = {}
    for d in docs.itertuples():
        raw = (d.text or "").encode()
        padded = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        image = b"P6\n64 %d\n255\n" % (len(padded) // 192) + padded
        lines = (d.text or "").split("\n")
        half = -(-len(lines) // 2)
        parts = [[" ".join(x.split()) for x in some] for some in (lines[:half], lines[half:])]
        caption = f"document of {len(raw)} bytes"
        items = [*(("text", x, "", "") for x in parts[0] if x), ("media", "", hashlib.sha256(padded).hexdigest(), caption), *(("text", x, "", "") for x in parts[1] if x)]
        whole = "".join("\x1f".join((str(k), *i)) + "\x1e" for k, i in enumerate(items))
        out[d.doc_id] = {
            "n_bytes": len(raw), "payload_bytes": len(padded), "payload_sha256": hashlib.sha256(padded).hexdigest(), "tail_crc32": zlib.crc32(padded[-16:]), "media_bytes": len(image), "media_sha256": hashlib.sha256(image).hexdigest(),
            "feature": feature(padded), "position": sum(map(bool, parts[0])), "caption": caption, "n_items": len(items), "sequence_sha256": hashlib.sha256(whole.encode()).hexdigest(),
        }
    return out


def feature(data):
    """Mean, spread, and which of 65 equal stretches have more than the one before."""
    edges = [len(data) * k // 65 for k in range(66)]
    sums = [sum(data[a:b]) for a, b in zip(edges[:-1], edges[1:])]
    mean = sum(data) / len(data)
    bits = int("".join("1" if b > a else "0" for a, b in zip(sums[:-1], sums[1:])), 2)
    return f"{mean:.3f}:{sum(x * x for x in data) / len(data) - mean ** 2:.3f}:{bits:016x}"


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """sizes: source -> words. Deals, caps, and deals the excess again."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, capped, left = dict.fromkeys(names, 0.0), set(), share * sum(sizes.values())
    while left > 1e-9:
        free = [s for s in names if s not in capped]
        if not free:
            break
        total = sum(w[s] for s in free)
        for s in free:
            target[s] += left * w[s] / total
        left = 0.0
        for s in free:
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                capped.add(s)
    return target


def fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, prints, radius=3):
    root = list(range(len(ids)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    a = np.array(prints, np.uint64)
    for i in range(len(a)):
        gaps = np.bitwise_count(a[:i] ^ a[i])
        for j in np.flatnonzero(gaps <= radius):
            x, y = top(i), top(int(j))
            root[max(x, y)] = min(x, y)
    least = defaultdict(lambda: None)
    for i in range(len(ids)):
        r = top(i)
        if ids[i] is not None and (least[r] is None or ids[i] < least[r]):
            least[r] = ids[i]
    return [least[top(i)] for i in range(len(ids))]


_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def secrets(text, scope=200):
    """Base spans and all spans, as (kind, start, end) sorted by start, then kind."""
    text = text or ""
    base = [(0, m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [(1, m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(2, m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    near = lambda a, b: a[1] - b[2] <= scope and b[1] - a[2] <= scope
    apart = lambda w: not any(b[1] <= w[1] and w[2] <= b[2] for b in base)
    access, assign = [b for b in base if b[0] == 1], [b for b in base if b[0] == 0]
    keys = [(3, m.start(), m.end()) for m in re.finditer("[A-Za-z0-9+/]+", text) if len(m[0]) == 40]
    keys = [w for w in keys if apart(w) and any(near(w, a) for a in access)]
    urls = [(4, m.start(), m.end()) for m in re.finditer(r"https?://[A-Za-z0-9.-]+(:[0-9]+)?", text)]
    urls = [w for w in urls if apart(w) and any(near(w, a) for a in access) and any(near(w, a) for a in assign + keys)]
    order = lambda spans: sorted(spans, key=lambda s: (s[1], s[0]))
    return order(base), order(base + keys + urls)


def written(spans):
    return ",".join(f"{('assign', 'access', 'hex', 'key', 'endpoint')[k]}:{s}:{e}" for k, s, e in spans)


def nearest(ids, vectors, queries, k=5):
    """query -> [(vec_id, score)], by cosine."""
    ok = [i for i, v in enumerate(vectors) if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = np.array([vectors[i] for i in ok], float)
    names = np.array([ids[i] for i in ok])
    norm = np.linalg.norm(x, axis=1)
    out = {}
    for i in range(len(ok)):
        if queries(names[i]):
            score = (x @ x[i]) / (norm * norm[i])
            score[i] = -np.inf
            best = np.lexsort((names, -score))[: min(k, len(ok) - 1)]
            out[int(names[i])] = [(int(names[j]), float(score[j])) for j in best]
    return out


def check_pieces(docs, pieces, encode, end, length=1024):
    """Every id in one piece, sequences gapless and within the length; returns the share of padding."""
    ids = {}
    for d in docs.itertuples():
        ids[d.doc_id] = np.array([*encode(d.text or ""), end], "<u4")
    for doc, own in pieces.sort_values("start").groupby("doc_id"):
        at = 0
        for p in own.itertuples():
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids[doc])
            assert zlib.crc32(ids[doc][at : at + p.length].tobytes()) == p.ids_crc32
            at += p.length
        assert at == len(ids[doc])
    assert set(pieces["doc_id"]) == set(ids)
    padding = total = 0
    for _, own in pieces.sort_values("offset").groupby("sequence_id"):
        at = 0
        for p in own.itertuples():
            assert p.offset == at
            at += p.length
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
        total += at
    return padding / max(1, padding + total)


def token_rows(docs, encode, end):
    out, at = {}, 0
    for d in docs.sort_values("doc_id").itertuples():
        ids = np.array([*encode(d.text or ""), end], "<u4")
        out[d.doc_id] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    return out


def judge(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default
