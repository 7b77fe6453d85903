"""Plain versions of the operators, for small inputs."""

import math
import random
import re
import statistics

LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def groups(docs, n, num, den):
    """[(id, text)] -> {row: smallest id reachable}."""
    sets = [shingles(t, n) for _, t in docs]
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and den * both >= num * (len(a) + len(sets[j]) - both):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    ids = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            ids[top(i)] = min(d, ids.get(top(i), d))
    return [ids.get(top(i), d) if sets[i] else d for i, (d, _) in enumerate(docs)], [len(s) for s in sets]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def contamination(text, bench, span=10):
    w, hit, items = words(text), set(), set()
    for item, t in bench:
        b = words(t)
        n = min(span, len(b))
        for s in range(len(b) - n + 1 if n and item is not None else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == b[s : s + n]:
                    hit.update(range(i, i + n))
                    items.add(str(item))
    return len(w), len(hit), sorted(items)


def prose(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def edited(r, text, share):
    return " ".join(f"x{r.randrange(10**6)}" if r.random() < share else w for w in text.split())


def near_copies(seed):
    """Texts of all sizes with exact copies, near copies, a large group of them, and common passages."""
    r = random.Random(seed)
    texts = [prose(r, r.choice([0, 1, 2, 3, 5, 9, 12, 20, 21, 30, 45, 80, 200])) for _ in range(60)]
    base, passage = prose(r, 120), prose(r, 25)
    texts += [edited(r, base, r.choice([0, 0.005, 0.01, 0.02, 0.05])) for _ in range(70)]
    texts += [prose(r, r.choice([5, 30, 100])) + " " + passage for _ in range(40)]
    for t in list(texts[:60]):
        texts += [t.upper(), t + " tail"] if r.random() < 0.5 else [edited(r, t, 0.02)]
    r.shuffle(texts)
    return [(i * 7 % 1009, t) for i, t in enumerate(texts)] + [(5000, None), (5001, "  \t"), (None, texts[0])]


def secrets(text):
    """The base kinds by walking the text character by character."""
    text, found = text or "", []
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    low = text.translate(LOW)
    value = set(letters + letters.upper() + digits + "+/_.=-")

    def run(i, chars):
        while i < len(text) and text[i] in chars:
            i += 1
        return i

    def assign(i):
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if low.startswith(word, i):
                j = i + len(word)
                j = run(j + (text[j : j + 1] in ("'", '"')), " ")
                if text[j : j + 1] in (":", "="):
                    j = run(j + 1, " ")
                    j += text[j : j + 1] in ("'", '"')
                    return j, run(j, value), 6
        return i, i, 1

    def access(i):
        end = run(i + 4, letters.upper() + digits) if text.startswith("AKIA", i) else i
        return i, end if end > i + 4 else i, 20

    for kind, match in (("assign", assign), ("access", access), ("hex", lambda i: (i, run(i, "abcdef" + digits), 24))):
        i = 0
        while i < len(text):
            start, end, least = match(i)
            if end > start:
                if end - start >= least:
                    found.append((i, ("assign", "access", "hex").index(kind), f"{kind}:{i}:{end}"))
                i = end
            else:
                i += 1
    return [x for _, _, x in sorted(found)]


def posteriors(rows):
    """[(host, path, share of good)] -> {(host, path): (host posterior, path posterior)}, by loops."""
    sites, hosts = {}, {}
    for h, p, g in rows:
        sites.setdefault((h, p), []).append(g)
        hosts.setdefault(h, []).append(g)
    share = (sum(g for _, _, g in rows) + 1) / (len(rows) + 2)

    def weight(groups):
        """groups: [(shares of good, prior)]."""
        if not groups:
            return 2.0
        spread = sum(len(g) * (sum(g) / len(g) - prior) ** 2 - prior * (1 - prior) for g, prior in groups) / sum(len(g) for g, _ in groups)
        return min(10_000.0, max(2.0, share * (1 - share) / max(spread, 1e-6) - 1))

    w = weight([(g, share) for g in hosts.values()])
    of_host = {h: (sum(g) + w * share) / (len(g) + w) for h, g in hosts.items()}
    w = weight([(g, of_host[h]) for (h, _), g in sites.items()])
    return {(h, p): (of_host[h], (sum(g) + w * of_host[h]) / (len(g) + w)) for (h, p), g in sites.items()}


def cosine_bits(image):
    """The 64 lowest frequencies of the image's means over 32 x 32 cells, told from their median, by the definition."""
    rows, cols = len(image), len(image[0])
    tall, wide = -(-32 // rows) if rows < 32 else 1, -(-32 // cols) if cols < 32 else 1
    big = [[image[y // tall][x // wide] for x in range(cols * wide)] for y in range(rows * tall)]
    edge = lambda i, n: i * n // 32
    cell = [[0.0] * 32 for _ in range(32)]
    for i in range(32):
        for j in range(32):
            part = [v for line in big[edge(i, len(big)) : edge(i + 1, len(big))] for v in line[edge(j, len(big[0])) : edge(j + 1, len(big[0]))]]
            cell[i][j] = sum(part) / len(part)
    cos = [[math.cos(math.pi * (2 * i + 1) * k / 64) for i in range(32)] for k in range(8)]
    low = [round(sum(cos[u][i] * cos[v][j] * cell[i][j] for i in range(32) for j in range(32)), 6) for u in range(8) for v in range(8)]
    middle = statistics.median(low[1:])
    bits = "".join("0" if n == 0 else str(int(x > middle)) for n, x in enumerate(low))
    return f"{int(bits, 2):016x}"


BLANKS = " \t\n\x0b\f\r"


def linked_quotes(rows):
    """[(thread, order, text)], each once -> {(thread, order): (own, parent, root, depth)} and [(thread, order, passage, level, original)]."""
    tidy = lambda t: " ".join(x for x in re.split(f"[{BLANKS}]+", t.lower()) if x)
    parts, said = {}, {}
    for t, o, text in rows:
        own, runs, before = [], [], None
        for line in re.split("\r?\n", text or ""):
            level, i = 0, 0
            while True:
                j = i
                while j < len(line) and line[j] in BLANKS:
                    j += 1
                if line[j : j + 1] != ">":
                    break
                level, i = level + 1, j + 1
            if level and line[i : i + 1] and line[i] in BLANKS:
                i += 1
            if level == 0:
                own.append(line)
            elif level == before:
                runs[-1][1].append(line[i:])
            else:
                runs.append((level, [line[i:]]))
            before = level
        whole = "\n".join(own).strip(BLANKS)
        parts[t, o] = whole, runs
        for x in [*own, whole]:
            if tidy(x):
                said[t, tidy(x)] = min(o, said.get((t, tidy(x)), o))
    links, parent = [], {}
    for (t, o), (_, runs) in parts.items():
        best = []
        for n, (level, lines) in enumerate(runs):
            tried = [(w, len(tidy(x)), said[t, tidy(x)]) for w, x in [(1, "\n".join(lines)), *((0, x) for x in lines)] if tidy(x) and said.get((t, tidy(x)), o) < o]
            if tried:
                _, size, original = max(tried)
                links.append((t, o, n, level, original))
                best += [(size, n, original)] * (level == 1)
        if best:
            parent[t, o] = max(best)[2]
    out = {}
    for t, o in parts:
        at, depth = o, 0
        while (t, at) in parent:
            at, depth = parent[t, at], depth + 1
        out[t, o] = parts[t, o][0], parent.get((t, o)), at, depth
    return out, sorted(links)
