"""Plain versions of the operators, for small inputs."""

import datetime
import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def stats(text):
    w = words(text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def shingles(text):
    w = words((text or "").translate(FOLD))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near(rows):
    """{doc_id: (n_shingles, component)} of (doc_id, text) rows by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def without_boilerplate(rows, ratio=0.05, least=5):
    """{k: text} of rows (host, text)."""
    pages, lines = Counter(h for h, _ in rows), Counter()
    for h, t in rows:
        lines.update((h, x) for x in {x for x in (t or "").split("\n") if WORD.search(x)})
    gone = {(h, x) for (h, x), n in lines.items() if h is not None and n >= least and n > ratio * pages[h]}
    return [None if t is None else "\n".join(x for x in t.split("\n") if (h, x) not in gone) for h, t in rows]


def luhn(digits):
    d = [int(x) for x in digits][::-1]
    return (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def check_passages(texts, rows, n=50):
    """Asserts that rows say nothing false, cover every place but the first of each run of n words that repeats, and link all documents with it."""
    own = [words(t.translate(FOLD)) for t in texts]
    covered, top = {k: set() for k in range(len(own))}, list(range(len(own)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for r in rows:
        a, b = own[r.doc_id][r.start_word : r.end_word], own[r.ref_doc_id][r.ref_start_word : r.ref_end_word]
        assert len(a) == r.end_word - r.start_word >= n and len(b) == r.ref_end_word - r.ref_start_word
        assert n <= 1.25 * r.n_equal and r.n_equal >= 0.8 * max(len(a), len(b)) and (r.n_equal < len(a) or a == b)
        assert (r.ref_doc_id, r.ref_start_word) < (r.doc_id, r.start_word)
        covered[r.doc_id].update(range(r.start_word, r.end_word))
        top[find(r.doc_id)] = find(r.ref_doc_id)
    places = {}
    for d, w in enumerate(own):
        for k in range(len(w) - n + 1):
            places.setdefault(tuple(w[k : k + n]), []).append((d, k))
    for found in places.values():
        for d, k in found[1:]:
            assert covered[d].issuperset(range(k, k + n)) and find(d) == find(found[0][0]), (found[0], d, k)


_END = r"(?![0-9A-Za-z_]|[.-]\d)"
_PII = re.compile(
    r"(?<![A-Za-z0-9._%+-])(?P<mail>[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.){1,8}[A-Za-z]{2,24})"
    r"""|(?<=["'=: ])(?P<secret>[0-9a-f]{40})(?=["' ,;]|$)"""
    r"|(?<![0-9A-Za-z_.+-])(?:"
    rf"(?P<ip>\d{{1,3}}(?:\.\d{{1,3}}){{3}}){_END}|(?P<ssn>\d{{3}}-\d\d-\d{{4}}){_END}"
    rf"|(?P<iso>\d{{4}}-\d\d-\d\d){_END}|(?P<dot>\d\d\.\d\d\.\d{{4}}){_END}|(?P<slash>\d\d/\d\d/\d{{4}}){_END}"
    rf"|(?P<phone>(?:\+?1[ .-]?)?(?:\(\d{{3}}\) ?|\d{{3}}[ .-])\d{{3}}[ .-]\d{{4}}){_END}"
    rf"|(?P<card>\d{{4}}(?:[ -]\d{{4}}){{2}}[ -]\d{{1,7}}|\d{{4}}[ -]\d{{6}}[ -]\d{{4,5}}|\d{{13,19}}){_END}"
    r"|(?P<stamp>\d{4}-\d\d-\d\d)(?=[Tt_]\d\d:))",
    re.ASCII,
)
_LENGTHS = {"4": (13, 16, 19), **{f"5{k}": (16,) for k in range(1, 6)}, **{f"2{k}": (16,) for k in range(2, 8)}, "34": (15,), "37": (15,), "30": (14,), "36": (14,), "38": (14,), "39": (14,), "35": (16,)}
_LENGTHS |= {x: range(13, 20) for x in ("50", "56", "57", "58", "59", *(f"6{k}" for k in range(10)))}


def _permuted(kind, key, n, a, b):
    left, right = divmod(n, b)
    some = lambda k, x, m: int(hashlib.md5(f"{key}:{kind}:{k}:{x}".encode()).hexdigest()[:15], 16) % m
    for k in range(8):
        if k % 2:
            right = (right + some(k, left, b)) % b
        else:
            left = (left + some(k, right, a)) % a
    return left * b + right


def _pseudonym(kind, hit, key):
    """None if the value is not valid."""
    d = re.sub("[^0-9]", "", hit)
    if kind == "mail":
        return "u" + hashlib.sha256(f"{key}:email:{hit.lower()}".encode()).hexdigest()[:32] + hit[hit.index("@") :]
    if kind == "secret":
        return hashlib.sha256(f"{key}:secret:{hit}".encode()).hexdigest()[:40]
    if kind == "ip":
        octets = hit.split(".")
        if any(str(int(o)) != o or int(o) > 255 for o in octets):
            return None
        return ".".join(map(str, _permuted("ip", key, int.from_bytes(bytes(map(int, octets))), 65536, 65536).to_bytes(4)))
    if kind == "ssn":
        areas = [x for x in range(1, 900) if x != 666]
        area, group, serial = int(d[:3]), int(d[3:5]), int(d[5:])
        if area not in areas or not group or not serial:
            return None
        top, low = divmod(_permuted("ssn", key, (areas.index(area) * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999), 9999)
        return f"{areas[top // 99]:03d}-{top % 99 + 1:02d}-{low + 1:04d}"
    if kind in ("iso", "stamp", "dot", "slash"):
        order = {"dot": "%d.%m.%Y", "slash": "%m/%d/%Y"}.get(kind, "%Y-%m-%d")
        try:
            day = datetime.datetime.strptime(hit, order).date()
        except ValueError:
            return None
        n = (day - datetime.date(1800, 1, 1)).days
        if not 0 <= n < 773 * 189:
            return None
        return (datetime.date(1800, 1, 1) + datetime.timedelta(_permuted("date", key, n, 773, 189))).strftime(order)
    if kind == "phone":
        dialled = d[-10] >= "2" and d[-7] >= "2"
        front, line = int(d[-10:-4]), int(d[-4:])
        if dialled:
            rank, side = (front // 1000 - 200) * 800 + front % 1000 - 200, 80000
        else:
            rank, side = front if front < 200_000 else 200_000 + (front // 1000 - 200) * 200 + front % 1000, 60000
        rank, line = divmod(_permuted("phone", key, rank * 10000 + line, side, side), 10000)
        if dialled:
            front = (rank // 800 + 200) * 1000 + rank % 800 + 200
        else:
            front = rank if rank < 200_000 else ((rank - 200_000) // 200 + 200) * 1000 + (rank - 200_000) % 200
        new = d[:-10] + f"{front:06d}{line:04d}"
    else:
        if len(d) not in _LENGTHS.get(d[0], _LENGTHS.get(d[:2], ())) or not luhn(d):
            return None
        n = len(d) - 3
        body = d[:2] + str(_permuted("card", key, int(d[2:-1]), 10 ** (n // 2), 10 ** (n - n // 2))).zfill(n)
        new = body + next(c for c in "0123456789" if luhn(body + c))
    digits = iter(new)
    return re.sub("[0-9]", lambda _: next(digits), hit)


def pseudonymised(text, key):
    """(text, number of values replaced)."""
    n = 0

    def put(m):
        nonlocal n
        new = _pseudonym(m.lastgroup, m.group(), key)
        n += new is not None and new != m.group()
        return new or m.group()

    return _PII.sub(put, text), n


def compacted(runs, target, fan, least, most):
    """(bytes, shards) of runs after size-tiered merging: each round merges in every tier, oldest first, groups up to most bytes."""

    def tier(b, n):
        mean, t = b / n, 0 if b / n <= least else 1
        while t and mean >= least * fan**t:
            t += 1
        return t if 2 * mean < target else None

    while True:
        groups = []
        for t in sorted({tier(*r) for r in runs} - {None}):
            cur = []
            for k, r in enumerate(runs):
                if tier(*r) == t:
                    if cur and sum(runs[x][0] for x in cur) + r[0] > most:
                        groups.append(cur)
                        cur = []
                    cur.append(k)
            groups.append(cur)
        groups = [g for g in groups if sum(runs[k][1] for k in g) >= fan]
        if not groups:
            return runs
        gone = {k for g in groups for k in g}
        made = [(sum(runs[k][0] for k in g), max(1, -(-sum(runs[k][0] for k in g) // target))) for g in groups]
        runs = [r for k, r in enumerate(runs) if k not in gone] + made
