"""Plain versions of the operators, written for small inputs and apart from the engine's code."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def labels(found, kinds):
    found = sorted(found, key=lambda x: (x[0], kinds.index(x[1])))
    return ",".join(f"{k}:{s}:{e}" for s, k, e in found)


def pii(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()]
        if 14 <= len(digits) <= 19 and sum(sum(divmod(d * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0:
            out.append((m.start(), "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), "phone", m.end()))
    return labels(out, ["email", "ip", "card", "phone"])


def iban(text):
    raw = text.replace(" ", "")
    return 15 <= len(raw) <= 34 and int("".join(str(int(c, 36)) for c in raw[4:] + raw[:4])) % 97 == 1


def secrets(text):
    text, out = text or "", []
    word = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    for m in re.finditer(rf"({word})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m.group(2)) >= 8:
            out.append((m.start(), "assign", m.end()))
    for kind, pattern, least in (("access", r"AKIA[A-Z0-9]+", 16), ("hex", r"[0-9a-f]+", 32)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m.group()) >= least]
    return labels(out, ["assign", "access", "hex"])


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def shingle_set(text, k):
    words = WORD.findall((text or "").translate(ASCII_LOWER))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near(docs, k, share=80):
    """(id -> component) of a list of (id, text)."""
    sets = [(d, shingle_set(t, k)) for d, t in docs]
    pairs = []
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a == b or x and y and 100 * len(x & y) >= share * len(x | y):
                pairs.append((a, b))
    return components(pairs, {d for d, _ in docs})


def conversation(rows):
    """(turns, turns digest, loss characters, loss digest) of (turn, role, text) rows."""
    rows = sorted(((t is not None, t or 0, r or "", x or "") for t, r, x in rows))
    learned = "".join(x for *_, r, x in rows if r == "assistant")
    return len(rows), sha("".join(f"{r}\n{x}\n" for *_, r, x in rows)), len(learned), sha(learned)


def url_host(url):
    """The host of a URL by plain steps, or None."""
    url = (url or "").strip(" ").lower()
    scheme, found, rest = url.partition("://")
    if not found or not re.fullmatch("[a-z][a-z0-9+.-]*", scheme):
        return None
    for mark in "/?#\\":
        rest = rest.partition(mark)[0]
    host = rest.rpartition("@")[2]
    if host.startswith("["):
        host, end, _ = host.partition("]")
        return host + "]" if end else None
    host = host.partition(":")[0]
    if re.search(r"[\[\]]", host):
        host = re.split(r"[\[\]]", host)[0]
    return host.removesuffix(".") or None


def url_verdict(host, at, entries):
    """The longest matching domain's list that is active at a time, or None."""
    best = None
    labels = host.split(".")
    alone = host.startswith("[") or re.fullmatch("[0-9]+([.][0-9]+){3}", host) or len(host) > 253
    for name in {n for n, *_ in entries}:
        for k in range(1 if alone else len(labels)):
            domain = ".".join(labels[k:])
            log = sorted((t, 0 if a == "add" else 1, a) for n, d, t, a in entries if n == name and d == domain and t <= at)
            if log and log[-1][2] == "add":
                best = min(best, (-len(domain), name)) if best else (-len(domain), name)
    return best[1] if best else None


def _tokens_hash(tokens):
    """The engine's hash of an array of texts, by which ties between leaders go."""
    h = 42
    for t in tokens:
        h = xxhash.xxh64_intdigest(t.encode(), h)
    return h - 2**64 if h >= 2**63 else h


def line_templates(docs, min_tokens=3, long_tokens=6, short_count=5, similarity=0.7, leading=3):
    """(cleaned text, lines, dropped lines) by document of a template tree over (id, text) pairs, each id once."""
    leaves, where = defaultdict(Counter), defaultdict(list)
    for d, text in docs:
        for k, line in enumerate((text or "").split("\n") if d is not None and text is not None else ()):
            plain = WORD.findall(line)
            if len(plain) < min_tokens:
                continue
            masked = tuple("<*>" if re.search("[0-9]", w) else w for w in plain)
            if re.search("[0-9]", line) and 2 * masked.count("<*>") > len(masked):
                leaf, key = ("exact", *plain), (*plain, "\n")
            else:
                leaf, key = (len(masked), *masked[:leading]), masked
            leaves[leaf][key] += 1
            where[leaf, key].append((d, k))
    gone = defaultdict(set)
    for leaf, lines in leaves.items():
        templates = []
        for key, n in sorted(lines.items(), key=lambda x: (x[1], _tokens_hash(x[0])), reverse=True):
            for t in templates:
                if leaf[0] != "exact" and sum(a == b for a, b in zip(t[0], key)) >= similarity * len(key):
                    t.append(key)
                    break
            else:
                templates.append([key])
        for t in templates:
            at = [x for key in t for x in where[leaf, key]]
            owner = min(d for d, _ in at)
            n = len(t[0]) - (leaf[0] == "exact")
            if owner < max(d for d, _ in at) and (n >= long_tokens or len(at) >= short_count):
                for d, k in at:
                    if d != owner:
                        gone[d].add(k)
    out = {}
    for d, text in docs:
        lines = text.split("\n") if text is not None else []
        kept = [x for k, x in enumerate(lines) if k not in gone[d]]
        out[d] = (None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def _terms(text):
    return [t for t in (re.sub(r"^[\W_]+|[\W_]+$", "", w) for w in text.lower().split()) if t]


def leaks(docs, items, threshold=0.6, overlap=0.6, k1=1.2, b=0.75, segment=128):
    """{(doc, item): (passages, score, question, answer)} by BM25 of every unit against every passage.

    For items of at most a segment, each id once."""
    units = {}
    for item, text in items:
        if text and item is not None:
            parts = [p for p in (_terms(x) for x in re.split(r"(?<=[.!?])\s+|\n+", text)) if p]
            asked, answer = ([t for p in parts[:-1] for t in p], parts[-1]) if len(parts) > 1 else (parts[0] if parts else [], [])
            if asked or answer:
                assert len(asked) + len(answer) <= segment
                units[item] = (asked, answer, Counter(asked + answer))
    n = len(units)
    mean = sum(u.total() for *_, u in units.values()) / max(1, n)
    step = max([16, *(u.total() for *_, u in units.values())])
    df = Counter(t for *_, u in units.values() for t in u)
    weight = {}
    for item, (*_, u) in units.items():
        one = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * u.total() / mean)) for t, f in u.items()}
        weight[item] = {t: x / sum(one.values()) for t, x in one.items()}
    out = {}
    for d, text in docs:
        pieces = (text or "").lower().split()
        for at in range(0, len(pieces), step):
            passage = _terms(" ".join(pieces[at : at + 2 * step]))
            words, pairs = set(passage), set(zip(passage, passage[1:]))
            for item, (asked, answer, _) in units.items():
                score = sum(x for t, x in weight[item].items() if t in words)
                if score < threshold - 1e-9:
                    continue
                wanted = set(zip(asked, asked[1:]))
                question = len(wanted & pairs) / len(wanted) if wanted else len(set(asked) & words) / len(set(asked)) if asked else 1.0
                said = len(set(answer) & words) / len(set(answer)) if answer else 1.0
                if question >= overlap and said >= overlap:
                    was = out.get((d, item), (0, 0.0, 0.0, 0.0))
                    out[d, item] = (was[0] + 1, *map(max, zip(was[1:], (score, question, said))))
    return out
