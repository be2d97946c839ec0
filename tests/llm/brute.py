"""Plain single-process versions of the operators' contracts."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
RULES = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)


def sha(s) -> str:
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def secrets(text):
    spans, counts = [], []
    for k, (kind, rx, group, least) in enumerate(RULES):
        own = [(m.start(), k, kind, m.end()) for m in rx.finditer(text or "") if len(m.group(group)) >= least]
        counts.append(len(own))
        spans += own
    return (*counts, sha(",".join(f"{kind}:{s}:{e}" for s, _, kind, e in sorted(spans))))


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    seen = defaultdict(list)
    for i in range(len(w) - 4):
        seen[tuple(w[i:i + 5])].append(i)
    repeat = {i + k for v in seen.values() if len(v) > 1 for i in v for k in range(5)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    failed = len(w) < 10 or 100 * len(repeat) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeat), failed


def suffixes(texts, length=200):
    """(n_bytes, n_removed, n_spans, kept digest) for each text."""
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if count[d[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((len(d), sum(gone), spans, sha(bytes(c for c, g in zip(d, gone) if not g))))
    return out


def substrings(rows, n=50):
    """(n_words, n_removed, kept digest) for each (id, text)."""
    first, split = {}, [WORD.findall(t or "") for _, t in rows]
    for (i, _), w in zip(rows, split):
        if i is not None:
            for k in range(len(w) - n + 1):
                key = tuple(w[k:k + n])
                first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, split):
        gone = [False] * len(w)
        if i is not None:
            for k in range(len(w) - n + 1):
                if first[tuple(w[k:k + n])] < i:
                    gone[k:k + n] = [True] * n
        out.append((len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def shingles(text):
    w = WORD.findall((text or "").translate(ASCII_LOWER))
    if not w:
        return set()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def jaccard(rows, percent=75):
    """(n_shingles, component id) for each (id, text)."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    lists = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            lists[x].append(k)
    shared = Counter()
    for v in lists.values():
        for i, a in enumerate(v):
            for b in v[i + 1:]:
                shared[a, b] += 1
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            up[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return [(len(s), low.get(find(k))) for k, s in enumerate(sets)]


def decontaminate(texts, items):
    """(n_words, n_hit, n_items, items digest, contaminated) for each text."""
    windows = defaultdict(lambda: defaultdict(set))
    for name, t in items:
        w = ALNUM.findall((t or "").translate(ASCII_LOWER))
        m = min(10, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            windows[m][tuple(w[i:i + m])].add(name)
    out = []
    for t in texts:
        w = ALNUM.findall((t or "").translate(ASCII_LOWER))
        hit, found = [False] * len(w), set()
        for m, own in windows.items():
            for i in range(len(w) - m + 1):
                names = own.get(tuple(w[i:i + m]))
                if names:
                    found |= names
                    hit[i:i + m] = [True] * m
        names = sorted(str(x) for x in found if x is not None)
        out.append((len(w), sum(hit), len(names), sha(",".join(names)), any(hit)))
    return out


def chat(rows):
    """conv_id -> (n_turns, turns digest, loss chars, loss digest) of (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    out = {}
    for c, turns in own.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
    return out


def ranked(docs, items, top=50):
    """(item_id, rank, doc_id, score), every document scored for every item."""
    import math
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    held = [(i, Counter(term.findall((t or "").translate(ASCII_LOWER)))) for i, t in docs]
    held = [(i, c, c.total()) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        terms = set(term.findall((text or "").translate(ASCII_LOWER)))
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in terms}
        scored = []
        for i, c, n in held:
            m = 50 + 50 * n * n_docs // n_terms
            score = sum(weight[t] * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        scored.sort(key=lambda x: x[:3])
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(scored[:top])]
    return out


def damaged(rows):
    """conv_id -> its rows (turn, role, text) after damage, in order."""
    import zlib
    out = defaultdict(list)
    sp = lambda x: " " if x is None else x
    for conv, turn, role, text in rows:
        mine, fate = out[conv], zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        role, text = sp(role), sp(text)
        if fate == 1:
            text = ""
        elif fate == 2:
            text = re.sub("[.!?]", "", text)
        elif fate == 4:
            role = "user"
        mine += [] if fate == 0 else [(turn, role, text)] * (2 if fate == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, v in out.items()}


def repaired(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest): the search tries
    edits in order of (cost, audit), so the first whole repair is the answer."""
    import heapq
    faults, seen = [], set()
    for _, role, text in rows:
        last = re.search(r"[^\x20\x09-\x0D][\x20\x09-\x0D]*\Z", text)
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else
                      "truncated" if text[last.start()] not in ".!?" else "")
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, roles, kept = heapq.heappop(heap)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            break
        if (at, roles[-1:]) in done:  # what may follow depends on the last role alone
            continue
        done.add((at, roles[-1:]))

        def push(mark, price, here, role=None, text=None):
            now = roles + (role[0] if role else "")
            if role is None or (role and re.fullmatch("(s?(ua)*u?)?", now)):
                heapq.heappush(heap, (cost + price, audit + mark, here, now, kept if role is None else (*kept, f"{role}:{text}")))

        for role in ("user", "assistant"):
            push("I", 2, at, role, "")
        if at < len(rows):
            _, role, text = rows[at]
            push("D", 3, at + 1)
            if faults[at] not in ("blank", "duplicate"):
                more = faults[at] == "truncated"
                if role:
                    push("K", more, at + 1, role, text)
                for new in ("user", "assistant"):
                    push("R", 2 + more, at + 1, new, text)
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha("\n".join(kept)))


def article(page):
    """Main text of a given page: its article's headings and paragraphs."""
    import html
    inside = re.search("<article>(.*?)</article>", page, re.S).group(1)
    blocks = (" ".join(html.unescape(re.sub("<[^>]*>", lambda m: " " if m.group() == "<br>" else "", b)).split())
              for b in re.split("</?(?:p|h1)>", inside))
    return "\n".join(b for b in blocks if b)
