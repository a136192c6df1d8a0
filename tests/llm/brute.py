"""Plain Python versions of the operators, for small inputs."""

import collections
import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def text_of(t):
    return t or ""


def quality(t):
    t, w = text_of(t), WORD.findall(text_of(t))
    lines, windows = [x for x in t.split("\n") if WORD.search(x)], collections.defaultdict(list)
    for i in range(len(w) - 2):
        windows[tuple(w[i:i + 3])].append(i)
    covered = {j for v in windows.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def divergence(rows, common):
    """(char_jsd, word_jsd, kept) of each (text, lang), by the rules' words."""
    vocabulary = list(dict.fromkeys(w for own in common.values() for w in own))
    facts, sums = [], {}
    for t, lang in rows:
        t, words = text_of(t), WORD.findall(text_of(t))
        n, failed = len(words), len(words) < 50 or 100 * quality(t)[4] > 50 * len(words)
        joined = "".join(words)
        signs = [sum(c in own for c in joined) for own in ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ".,;:!?'\"()-", "#*$%&|<>=+/@\\_{}[]^~")]
        wide = len(joined.encode()) - len(joined)
        chars = [max(0, len(joined) - wide - sum(signs)), wide, len(t) - len(joined), *signs]
        hits = [words.count(w) for w in vocabulary]
        hits.append(n - sum(hits))
        facts.append((len(t), n, failed, chars, hits))
        if not failed and lang in common:
            c, w = sums.setdefault(lang, ([0] * len(chars), [0] * len(hits)))
            sums[lang] = [a + b for a, b in zip(c, chars)], [a + b for a, b in zip(w, hits)]

    def jsd(p, q):
        p, q = [x / max(1, sum(p)) for x in p], [x / sum(q) for x in q]
        part = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b) if x > 0)
        return math.sqrt(max(0, part(p, q) + part(q, p)) / 2)

    out = []
    for n_chars, n, failed, chars, hits in facts:
        char = min(jsd(chars, c) for c, _ in sums.values()) if n_chars >= 200 else None
        word = min(jsd(hits, w) for _, w in sums.values()) if n >= 50 else None
        nothing = [0] * len(vocabulary) + [1]
        share = min(jsd(hits, w) / jsd(nothing, w) for _, w in sums.values())
        far = char is not None and char > 0.29 or n >= 50 and share > min(0.98, 0.25 + 7 / math.sqrt(n))
        out.append((char, word, not failed and not far))
    return out


def exact(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[text_of(t).translate(LOW)].append(i)
    return sorted((str(i), str(max((x for x in v if x is not None), default=None)), len(v), hashlib.sha256(k.encode()).hexdigest())
                  for k, v in groups.items() for i in v)


def near(rows, k, percent):
    sets = []
    for _, t in rows:
        w = WORD.findall(text_of(t).translate(LOW))
        sets.append({tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    low = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            low[find(n)] = min(low.get(find(n), i), i)
    return sorted((str(i), len(sets[n]), str(low.get(find(n)) if sets[n] else i)) for n, (i, _) in enumerate(rows))


def repeats(rows, depth=200):
    texts = [(i, text_of(t).encode()) for i, t in rows]
    seen = collections.Counter(b[p:p + depth] for _, b in texts for p in range(len(b) - depth + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - depth + 1):
            if seen[b[p:p + depth]] > 1:
                gone[p:p + depth] = b"\1" * depth
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(gone)))
        out.append((str(i), len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits), 1):
        c = int(c) * (2 - i % 2)
        total += c - 9 if c > 9 else c
    return total % 10 == 0


def personal(t):
    out = []
    for k, (name, rule) in enumerate(RULES.items()):
        for m in re.finditer(rule, text_of(t)):
            d = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": name == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                    "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[name]:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{list(RULES)[k]}:{a}:{b}" for a, k, b in sorted(out))


def model(rows, mu=4.0):
    texts = [(i, zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1, [*WORD.findall(text_of(t).translate(LOW)), "\n"]) for i, t in rows]
    one, two = collections.Counter(), collections.Counter()
    for _, held, w in texts:
        if not held:
            one.update(w)
            two.update(zip(["\n", *w], w, strict=False))
    n, v = sum(one.values()), len(one)
    p = lambda w: (one[w] + 0.5) / (n + 0.5 * (v + 1))
    return sorted((str(i), held, len(w), sum(one[x] > 0 for x in w), n, sum(math.log10(p(x)) for x in w),
                   sum(math.log10((two[a, b] + mu * p(b)) / (one[a] + mu)) for a, b in zip(["\n", *w], w, strict=False))) for i, held, w in texts)
