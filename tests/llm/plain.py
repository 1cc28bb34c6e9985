"""Plain versions of operators, one row at a time, to compare with."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")

BASE_KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def repeated_words(words):
    times = Counter(zip(words, words[1:], words[2:]))
    return len({i + s for i in range(len(words) - 2) if times[tuple(words[i : i + 3])] > 1 for s in range(3)})


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    def passes(kind, value):
        digits = re.sub("[^0-9]", "", value)
        if kind == "ip":
            return all(int(p) <= 255 for p in value.split("."))
        if kind == "card":
            return 13 <= len(digits) <= 19 and luhn(digits)
        return kind == "email" or 9 <= len(digits) <= 15

    return [(k, m.start(), m.end()) for k, p in BASE_KINDS for m in re.finditer(p, text or "") if passes(k, m.group())]


def shingle_set(text):
    words = WORD.findall(text or "")
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def near_copies(rows, similarity=0.8):
    """doc_id -> (class_id, n_links, class_size) by comparing every pair of texts that share a shingle."""
    sets = defaultdict(list)
    alone = {}
    for doc_id, text in rows:
        s = shingle_set(text)
        if s and doc_id is not None:
            sets[s].append(doc_id)
        else:
            alone[doc_id] = (doc_id, 0, 1)
    keys = list(sets)
    holders = defaultdict(list)
    linked = defaultdict(set)
    for i, s in enumerate(keys):
        common = Counter(j for x in s for j in holders[x])
        for j, n in common.items():
            if n >= similarity * (len(s) + len(keys[j]) - n) - 1e-9:
                linked[i].add(j)
                linked[j].add(i)
        for x in s:
            holders[x].append(i)
    out, seen = dict(alone), set()
    for i in range(len(keys)):
        if i in seen:
            continue
        group, stack = set(), [i]
        while stack:
            j = stack.pop()
            if j not in group:
                group.add(j)
                stack += linked[j]
        seen |= group
        members = [d for j in group for d in sets[keys[j]]]
        for j in group:
            links = len(sets[keys[j]]) - 1 + sum(len(sets[keys[o]]) for o in linked[j])
            for d in sets[keys[j]]:
                out[d] = (min(members), links, len(members))
    return out
