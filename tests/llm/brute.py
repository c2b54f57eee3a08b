"""Plain Python versions of what the operators must return, without Spark."""

import hashlib
import re
import struct
import zlib
from collections import defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def near_duplicates(docs):
    """docs: [(id, text)] -> sorted [(id, n_shingles, component, kept)]."""
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    common = defaultdict(int)
    for own in holders.values():
        for k, i in enumerate(own):
            for j in own[:k]:
                common[j, i] += 1
    for (i, j), n in common.items():
        if 100 * n >= 75 * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(sets[i]), least.get(root(i)), d == least.get(root(i))) for i, (d, _) in enumerate(docs)), key=str)


def contamination(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, t in items:
        w = word.findall((t or "").translate(LOWER))
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(str(item))
    lengths = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w = word.findall((t or "").translate(LOWER))
        hit, items_of = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    items_of |= found
        out.append((d, len(w), len(hit), len(items_of), sha(",".join(sorted(items_of))), bool(hit)))
    return sorted(out, key=str)


def base_secrets(docs):
    keys = r"(password|passwd|secret|token|api_?key)"
    kinds = [
        ("assign", re.compile(keys + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ]
    out = []
    for d, t in docs:
        spans = sorted((m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, p, ok) in enumerate(kinds) for m in p.finditer(t or "") if ok(m))
        out.append((d, *[sum(s[1] == k for s in spans) for k in range(3)], sha(",".join(s[2] for s in spans))))
    return sorted(out, key=str)


def all_spans(text):
    """Every span of a text as kind:start:end, entropy ones found by counting each window anew."""
    import math

    text = text or ""
    keys = r"(?i:password|passwd|secret|token|api_?key)"
    base = [(m.start(), 0, m.end()) for m in re.finditer(keys + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 6]
    base += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    base += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 24]
    high = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        run, kinds = m[0], {"d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else "s" for c in m[0]}
        if "d" not in kinds or not kinds & {"l", "u"} or any(s <= m.start() and m.end() <= e for s, _, e in base):
            continue
        parts = re.split("[/_=-]", run.rstrip("0123456789"))
        named = len(run) - len(run.rstrip("0123456789")) <= 4 and all(x.isalpha() for x in parts)
        uuid = [len(x) for x in run.split("-")] == [8, 4, 4, 4, 12] and set(run) <= set("0123456789abcdef-")
        if named or uuid or len(set(run)) == 1 or any(k in run for k in ("EXAMPLE", "0123456789", "abcdefghijklm", "ABCDEFGHIJKLM")):
            continue
        least = 3.2 if set(run) <= set("0123456789abcdef") or set(run) <= set("0123456789ABCDEF") else 3.6 if kinds in ({"d", "u"}, {"d", "l"}) else 3.9
        bits = lambda w: -sum(w.count(c) / 20 * math.log2(w.count(c) / 20) for c in set(w))
        found = [i for i in range(len(run) - 19) if bits(run[i : i + 20]) >= least - 1e-9]
        if found:
            high.append((m.start() + found[0], 3, m.start() + found[-1] + 20))
    high = [h for h in high if not any(s <= h[0] and h[2] <= e for s, _, e in base)]
    return ",".join(f"{('assign', 'access', 'hex', 'entropy')[k]}:{s}:{e}" for s, k, e in sorted(base + high))


def token_ids(texts, end):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [[*e.ids, end] for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def language(text, model):
    """(language, score, rejected) by loops over words, n-grams and languages."""
    import math

    size, step, out = 1 << 64, 0x9E3779B97F4A7C15, [0.0] * len(model.langs)
    buckets = []
    for word in re.sub(r"[\W\d_]+", " ", (text or "").lower()).split():
        held = f" {word} "
        for n in (2, 3, 4):
            for i in range(len(held) - n + 1):
                if " " not in held[i + 1 : i + n - 1]:
                    h = 0
                    for c in held[i : i + n]:
                        h = (h * step + ord(c)) % size
                    buckets.append(h)
        whole = 0
        for place, c in enumerate(word, 1):
            x = (ord(c) + place * step) * 0xBF58476D1CE4E5B9 % size
            whole = (whole + (x ^ x >> 31) * step) % size
        buckets.append(whole)
    if not any(map(str.isalpha, text or "")) or not model.langs:
        return "und", 0.0, True
    for h in buckets:
        at = (((h ^ h >> 30) * 0x94D049BB133111EB % size) >> 33) % (1 << 17)
        for k in range(len(out)):
            out[k] += float(model.table[at][k])
    z = [(x / len(buckets) + float(b)) / model.temperature for x, b in zip(out, model.bias, strict=True)]
    p = [math.exp(x - max(z)) for x in z]
    best = max(range(len(p)), key=p.__getitem__)
    score = p[best] / sum(p)
    return model.langs[best], score, score < model.threshold
