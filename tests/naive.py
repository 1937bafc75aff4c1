"""Plain sequential restatements of the clustering rules, for small catalogues."""

from __future__ import annotations

import math

import numpy as np

DAY = 86_400_000


def km(a, b, c, d):
    s = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 6371 * 2 * math.atan2(math.sqrt(s), math.sqrt(1 - s))


def rows(df):
    return [(int(r.row_idx), r.latitude, r.longitude, int(r.timeMs), r.magnitude) for r in df.itertuples()]


def window(df, law, share, by_time=True):
    ev = rows(df)
    order = sorted(range(len(ev)), key=lambda i: (-ev[i][4], *([ev[i][3]] if by_time else []), ev[i][0]))
    dependent, label, n = [False] * len(ev), [-1] * len(ev), 0
    for i in order:
        if dependent[i]:
            continue
        radius, days = law(ev[i][4])
        took = [j for j in range(len(ev)) if j != i and not dependent[j] and -days * DAY * share <= ev[j][3] - ev[i][3] <= days * DAY and km(ev[i][1], ev[i][2], ev[j][1], ev[j][2]) <= radius]
        for j in took:
            dependent[j] = True
        if took:
            for j in [i, *took]:
                label[j] = n
            n += 1
    return label, dependent


def gk(m):
    return 10 ** (0.1238 * m + 0.983), 10 ** (0.032 * m + 2.7389) if m >= 6.5 else 10 ** (0.5409 * m - 0.547)


def uhrhammer(m):
    return math.exp(-1.024 + 0.804 * m), math.exp(-2.870 + 1.235 * m)


def hardebeck(df, least, days=10, multiple=3, exclusion=3 * 365.25):
    ev = rows(df)
    length = lambda m: 10 ** (0.59 * m - 2.44)
    bad = {i for i, a in enumerate(ev) for b in ev if b[4] > a[4] and 0 < a[3] - b[3] < exclusion * DAY and km(b[1], b[2], a[1], a[2]) <= 5 * length(b[4])}
    label, n = [-1] * len(ev), 0
    for i in sorted((i for i, e in enumerate(ev) if e[4] >= least and i not in bad), key=lambda i: (-ev[i][4], ev[i][0])):
        if label[i] >= 0:
            continue
        for j, e in enumerate(ev):
            if label[j] < 0 and 0 < e[3] - ev[i][3] <= days * DAY and km(ev[i][1], ev[i][2], e[1], e[2]) <= max(10, multiple * length(ev[i][4])):
                label[j] = n
        label[i] = n
        n += 1
    return label


def density(n, near, least):
    """near(i): set of neighbours without i."""
    label, number = [None] * n, 0
    around = [near(i) for i in range(n)]
    core = [len(a) + 1 >= least for a in around]
    for i in range(n):
        if not core[i] or label[i] is not None:
            continue
        todo = [i]
        while todo:
            k = todo.pop()
            if label[k] is not None:
                continue
            label[k] = number
            if core[k]:
                todo += [j for j in around[k] if label[j] is None]
        number += 1
    return [-1 if x is None else x for x in label]


def decimal_year(ms):
    from datetime import UTC, datetime

    t = datetime.fromtimestamp(ms / 1000, UTC)
    a, b = datetime(t.year, 1, 1, tzinfo=UTC), datetime(t.year + 1, 1, 1, tzinfo=UTC)
    return t.year + (ms - a.timestamp() * 1000) / ((b - a).total_seconds() * 1000)


def first_seen(labels):
    """Renumber labels by their first place; None becomes -1."""
    names = {}
    return [-1 if x is None else names.setdefault(x, len(names)) for x in labels]


def in_time(df, mc):
    """Events of at least mc in time order: (row, lat, lon, year, magnitude)."""
    ev = [(i, a, o, decimal_year(t), m) for i, a, o, t, m in rows(df) if m >= mc]
    return sorted(ev, key=lambda e: (e[3], e[0]))


def looked_back(ev, t, before):
    return sum(t - before < e[3] < t for e in ev)


def spread(df, ev, label):
    of = {e[0]: x for e, x in zip(ev, first_seen(label))}
    return [of.get(int(r), -1) for r in df["row_idx"]]


def reach(m):
    return max(5.0, 10 ** (0.59 * m - 2.44))


def step_magnitude(df, mc, before, after):
    """Stated by sets: what a main takes is the least set that its two rules are closed under."""
    ev = in_time(df, mc)
    label = [None] * len(ev)
    for main in sorted(range(len(ev)), key=lambda i: (-ev[i][4], i)):
        if label[main] is not None:
            continue
        free = [i for i in range(len(ev)) if label[i] is None and i != main and km(*ev[main][1:3], *ev[i][1:3]) <= reach(ev[main][4])]
        lowest, took, grew = main - looked_back(ev, ev[main][3], before), {main}, True
        while grew:
            more = {i for i in free if lowest <= i < main} - took
            grew = bool(more)
            took |= more
            lowest = min([lowest, *(i - looked_back(ev, ev[i][3], before) for i in more)])
        clock = ev[main][3]
        for i in (i for i in free if i > main):
            if ev[i][3] > clock + after:
                break
            took.add(i)
            clock = ev[i][3] if ev[i][4] > mc else clock
        for i in took:
            label[i] = main
    return spread(df, ev, label)


def step_time(df, mc, before, after):
    ev = in_time(df, mc)
    label = [None] * len(ev)
    for first in range(len(ev)):
        if label[first] is not None or ev[first][4] <= mc:
            continue
        label[first] = first
        head, clock = first, ev[first][3]
        todo = max(0, first - looked_back(ev, clock, before))
        while todo < len(ev) and ev[todo][3] < clock + after:
            now = todo
            todo += 1
            if label[now] is None and km(*ev[head][1:3], *ev[now][1:3]) <= reach(max(ev[now][4], ev[head][4])):
                label[now] = first
                if ev[now][4] > mc:
                    clock = max(clock, ev[now][3])
                if ev[now][4] > ev[head][4]:
                    head = now
                    todo = max(1, now - looked_back(ev, clock, before))
    return spread(df, ev, label)


def reasenberg(df, rfact=10, tau0=2, tau_max=10, p1=0.99, xk=0.5, min_mag=1.5, tau_min=1):
    """Groups as lists of members in the order of joining."""
    ev = sorted(rows(df), key=lambda e: (e[3], e[0]))
    groups = []  # oldest first
    of = lambda i: next((g for g in groups if i in g["all"]), None)
    for i, a in enumerate(ev):
        for j in range(i + 1, len(ev)):
            b, g = ev[j], of(i)
            tau = tau0
            if g and a[3] > g["top"][3]:
                dm = max((1 - xk) * g["top"][4] - min_mag, 0)
                tau = max(tau_min, min(tau_max, -math.log(1 - p1) * (a[3] - g["top"][3]) / DAY / 10 ** ((dm - 1) * 2 / 3)))
            if (b[3] - a[3]) / DAY > tau:
                break
            h = of(j)
            if g is not None and g is h:
                continue
            r = min(rfact * 0.011 * 10 ** (0.4 * a[4]), 30) + (min(0.011 * 10 ** (0.4 * g["top"][4]), 30) if g else 0)
            if km(*a[1:3], *b[1:3]) > min(r, 30):
                continue
            if g is None and h is None:
                groups.append({"all": {i, j}, "top": b if b[4] > a[4] else a})
            else:
                both = [x for x in groups if x is g or x is h]
                keep, rest = both[0], both[1:]
                for extra, top in [(x["all"], x["top"]) for x in rest] or [({i} if h is keep else {j}, a if h is keep else b)]:
                    keep["all"] |= extra
                    keep["top"] = top if top[4] > keep["top"][4] else keep["top"]
                groups = [x for x in groups if x not in rest]
    label = [None] * len(ev)
    for n, g in enumerate(groups):
        for i in g["all"]:
            label[i] = n
    return spread(df, ev, label)


def spanning_edges(d: np.ndarray, k: int):
    """Core distances, and edges (w, a, b) of the lightest tree over all pairs in the order of (w, a, b)."""
    n = len(d)
    core = np.array([np.sort(np.delete(d[i], i))[min(k, n - 1) - 1] if n > 1 and k else 0.0 for i in range(n)])
    top = list(range(n))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    edges = []
    for w, a, b in sorted((max(core[a], core[b], d[a, b]), a, b) for a in range(n) for b in range(a + 1, n)):
        if find(a) != find(b):
            top[find(b)] = find(a)
            edges.append((w, a, b))
    return core, edges


def hdbscan(d: np.ndarray, min_size: int = 5, min_samples: int = 5):
    """Labels, strengths and outlier scores by the definitions: sets of rows split from the heaviest edge down."""
    n = len(d)
    least = max(2, min(min_size, n // 2))
    edges = spanning_edges(d, min_samples)[1]

    def parts(rows, edges):
        """Two halves without the last edge, with their own edges."""
        a = {edges[-1][1]}
        grew = True
        while grew:
            more = {x for _, p, q in edges[:-1] for x in (p, q) if (p in a) != (q in a)}
            grew = bool(more)
            a |= more
        return [(s, [e for e in edges[:-1] if e[1] in s]) for s in (a, rows - a)]

    clusters = []  # [birth, parent, {row: lam}, [parts], rows]

    def grow(rows, edges, birth, parent):
        me = len(clusters)
        clusters.append([birth, parent, {}, [], rows])
        while edges:
            lam = 1 / edges[-1][0] if edges[-1][0] > 0 else 1e15
            halves = parts(rows, edges)
            large = [h for h in halves if len(h[0]) >= least]
            for s, _ in halves:
                if len(s) < least:
                    clusters[me][2].update(dict.fromkeys(s, lam))
            if len(large) == 2:
                clusters[me][3] = [grow(*h, lam, me) for h in large]
            if len(large) != 1:
                break
            rows, edges = large[0]
        return me

    grow(set(range(n)), edges, 0.0, None)

    def best(c):
        birth, _, gone, kids, _ = clusters[c]
        own = max(0.0, sum(x - birth for x in gone.values()) + sum(len(clusters[k][4]) * (clusters[k][0] - birth) for k in kids))
        below = [best(k) for k in kids]
        value = sum(v for v, _ in below)
        return (own, [c]) if not kids or own >= value else (value, [x for _, xs in below for x in xs])

    def stays(c):
        return list(clusters[c][2].items()) + [(r, clusters[k][0]) for k in clusters[c][3] for r in clusters[k][4]]

    labels, strength, outlier = np.full(n, -1), np.zeros(n), np.zeros(n)
    for number, c in enumerate(sorted(best(0)[1], key=lambda c: min(clusters[c][4]))):
        got = stays(c)
        most = max(x for _, x in got)
        for r, x in got:
            labels[r], strength[r] = number, min(1.0, x / most)
    for birth, _, gone, kids, _ in clusters:
        most = max([*gone.values(), *(clusters[k][0] for k in kids)], default=0.0)
        for r, x in gone.items():
            if labels[r] < 0:
                outlier[r] = max(0.0, 1 - x / most) if most > 0 else 1.0
    return labels, strength, outlier
