"""Plain Python versions of the operators, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import combinations, permutations


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def jaccard(texts):
    """texts: list of (id, text) -> {position: (set size, component id)}."""
    sets = []
    for _, text in texts:
        w = words(text)
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    for a, b in {p for h in holders.values() for p in combinations(h, 2)}:
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            root[find(a)] = find(b)
    low = {}
    for i, (doc, _) in enumerate(texts):
        if doc is not None:
            low[find(i)] = min(doc, low.get(find(i), doc))
    return {i: (len(s), low.get(find(i)) if s else texts[i][0]) for i, s in enumerate(sets)}


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def hits(text, items):
    """(words, hit words, items found) of one text."""
    w, hit, found = bench_words(text), set(), set()
    for item, body in items:
        b = bench_words(body)
        n = min(13, len(b))
        windows = {tuple(b[i:i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i:i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(item)
    return len(w), len(hit), found


def language_model(texts, held, kappa, beta):
    """texts: list of texts -> [(tokens, known, base score, score)]; the order
    is one more than the number of kappas."""
    end, start, order = 0, 1, len(kappa) + 1
    seqs = [[start] + words(t) + [end] for t in texts]
    count = Counter()
    for s, h in zip(seqs, held):
        if not h:
            count.update(tuple(s[i:i + n]) for n in range(1, order + 1) for i in range(len(s) - n + 1))
    total = sum(c for g, c in count.items() if len(g) == 1 and g != (start,))
    types = sum(len(g) == 1 and g != (start,) for g in count)

    def prob(context, x):
        if not context:
            return (count[x,] + 0.5) / (total + 0.5 * (types + 1))
        c, lower = count[context], prob(context[1:], x)
        t = kappa[len(context) - 1] * c ** beta
        return (count[(*context, x)] + t * lower) / (c + t) if c else lower
    out = []
    for s in seqs:
        base = sum(math.log10(prob((), x)) for x in s[1:])
        score = sum(math.log10(prob(tuple(s[max(0, i - order + 1):i]), s[i])) for i in range(1, len(s)))
        out.append((len(s) - 1, sum(count[x,] > 0 for x in s[1:]), base, score))
    return total, out


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _tree(nodes):
    """Levels of a ternary tree, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([H(*below[i:i + 3]) for i in range(0, len(below), 3)])
    return levels


def _way(levels, i):
    """(left, right) siblings per level."""
    out = []
    for level in levels[:-1]:
        lo = i // 3 * 3
        out.append(("".join(level[lo:i]), "".join(level[i + 1:lo + 3])))
        i //= 3
    return out


def _leaf(doc, text, lang, source, n):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)])


def manifest(rows):
    """rows (doc_id, text, lang, source, n_chars) -> the verified rows."""
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, _leaf(*r)))
    trees = {s: _tree([_leaf(*r) for r in groups[s]]) for s in names}
    top = _tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (doc, text, lang, source, n) in enumerate(groups[s]):
            way = _way(trees[s], i) + _way(top, k)
            given = text
            if doc is not None and text is not None and zlib.crc32(str(doc).encode()) % 2 == 0:
                given = text.replace("\n", "")
            folded = _leaf(doc, given, lang, source, n)
            for left, right in way:
                folded = H(left, folded, right)
            out.append((doc, trees[s][0][i], trees[s][-1][0], top[-1][0], H(*[x for w in way for x in w]), folded, folded == top[-1][0]))
    return out


def formatted(role, text):
    for a, b in (("%", "%25"), (":", "%3A"), ("#", "%23"), ("<", "%3C"), ("\n", "%0A")):
        role = role.replace(a, b)
    for a, b in (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\e")):
        text = text.replace(a, b)
    return f"### {role}: {text}</turn>\n"


def ordered(turns):
    """conv -> [(role, text)] in order."""
    out = {}
    for conv, turn, role, text in turns:
        out.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [r[2:] for r in sorted(rows)] for c, rows in out.items()}


def chats(turns):
    out = {}
    for conv, said in ordered(turns).items():
        replies = [text for role, text in said if role == "assistant"]
        sizes = [len(formatted(*t)) for t in said]
        out[conv] = {
            "n_turns": len(said), "turns_sha256": H(*[x for role, text in said for x in (role, "\n", text, "\n")]),
            "loss_chars": sum(map(len, replies)), "loss_sha256": H(*replies), "formatted_chars": sum(sizes), "n_examples": len(replies),
            "expanded_chars": sum(sum(sizes[:i + 1]) for i, (role, _) in enumerate(said) if role == "assistant")}
    return out


def audit(docs, labels):
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    parts = {}
    for doc, text, lang in docs:
        text = text or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
        fails = set()
        if len(w) < 200:
            fails.add("A")
        if 100 * len(set(w)) < 50 * len(w):
            fails.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text):
            fails.add("C")
        if any(c in "#$%&*|" for c in text):
            fails.add("D")
        if doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in docs):
            fails.add("E")
        parts.setdefault(lang or "", []).append((fails, doc in good, doc in toxic))
    out = []
    for part, rows in parts.items():
        made, total = [], Counter()
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                earlier = set(order[:step - 1])
                total[f] += len(gone)
                made.append((f, part, "".join(order), step, len(left), len(gone), sum(f in r[0] and bool(r[0] & earlier) for r in rows),
                             sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)))
        out += [(*m[1:], total[m[0]]) for m in made]
    return out
