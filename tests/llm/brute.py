"""Plain Python versions of the operators' definitions, for small inputs."""

import hashlib
import html
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def counts(text):
    text, w, seen, dup = text or "", words(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def shingles(text, n):
    w = words(lower(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def classes(rows, n, percent):
    """rows: (id, text); component id for each row, in order."""
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) for i in range(len(rows))]


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        double = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in double) % 10 == 0
    return True


def base_spans(text):
    found = [(m.start(), r, m.end(), k) for r, k in enumerate(PII) for m in re.finditer(PII[k], text or "") if valid(k, m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def kept_words(rows, size):
    """rows: (id, text); the words that stay, for each row."""
    first = {}
    for doc, text in rows:
        w = words(text)
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            if doc is not None:
                first[key] = min(doc, first.get(key, doc))
    out = []
    for doc, text in rows:
        w = words(text)
        gone = {j for i in range(len(w) - size + 1) if doc is not None and first[tuple(w[i : i + size])] < doc for j in range(i, i + size)}
        out.append([x for i, x in enumerate(w) if i not in gone])
    return out


def plain(text):
    return re.sub(r"[^a-z0-9\x80-\U0010ffff]", " ", (text or "").lower()).split()


def edit_distance_in(pattern, text):
    """Least distance of the pattern to a stretch of the text."""
    before = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        now = [i]
        for j, t in enumerate(text, 1):
            now.append(min(before[j] + 1, now[j - 1] + 1, before[j - 1] + (p != t)))
        before = now
    return min(before)


def article(source):
    found = re.search(r"<article>(.*?)</article>", source or "", re.S)
    parts = re.split(r"</?(?:p|h1)>", found[1] if found else "")
    lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in parts]
    return "\n".join(x for x in lines if x)


def damaged(rows):
    """rows: (conv_id, turn, role, text)."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = lambda x: " " if x is None else str(x)
        fate = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def repair(rows):
    """rows: (turn, role, text) in order; the digest by carrying whole audits through every state."""
    blank = duplicate = truncated = illegal = 0
    seen, marks = set(), []
    for i, (_, role, text) in enumerate(rows):
        shown = re.sub(r"[\x20\x09-\x0D]", "", text)
        again = (role, text) in seen
        seen.add((role, text))
        cut = bool(shown) and not again and shown[-1] not in ".!?"
        blank, duplicate, truncated = blank + (not shown), duplicate + (bool(shown) and again), truncated + cut
        illegal += i > 0 and rows[i - 1][1][:1] + role[:1] not in ("su", "ua", "au")
        marks.append((not shown or again, cut))
    order = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", [])}

    def better(table, state, entry):
        if state not in table or entry[:2] < table[state][:2]:
            table[state] = entry

    def with_inserts(table):
        for _ in range(3):
            for state, (cost, audit, made) in list(table.items()):
                nxt = "a" if state == "u" else "u"
                better(table, nxt, (cost + 2, audit + "I", [*made, ("assistant" if nxt == "a" else "user") + ":"]))
        return table

    with_inserts(best)
    for (_, role, text), (must_go, cut) in zip(rows, marks):
        grown = {}
        for state, (cost, audit, made) in best.items():
            better(grown, state, (cost + 3, audit + "D", made))
            if not must_go:
                for letter, new, price in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                    if new[:1] and new[:1] in order[state]:
                        better(grown, new[:1], (cost + price + cut, audit + letter, [*made, f"{new}:{text}"]))
        best = with_inserts(grown)
    cost, audit, made = min((best[s] for s in ("", "a") if s in best), key=lambda e: e[:2])
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()


def trie(rows):
    """rows: (conv_id, turn, role, text); (conv_id, depth, parent, convs, children, leaves, saved, ends) per node."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(turns)] for c, turns in own.items()}
    members = {(): set()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
        for d in range(len(made[c]) + 1):
            members.setdefault(made[c][:d], set()).add(c)
    if not made:
        return []
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(made[c]) == len(p))
        out.append((
            min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out
