"""Host rules, whitening and vector codes against plain recomputation, edge rows included."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from panelwright.llm import host_rules, pivots, queries, whitening

from .test_edges import EXAMPLES, docs, empty  # noqa: F401

VECTORS = "vec_id long, embedding array<double>, label string, x int, n long, code string, error long, component int, _label string"


def vector_table(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, 2, "c", 3, 4, "l") for i, v, label in rows], VECTORS)


# Host rules --------------------------------------------------------------------


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered))


def plain_verdicts(rows):
    """rows: (host, text); returns base_failed and kept of each."""
    counted = [(host, plain_counts(text)) for host, text in rows]

    def fails(c):
        n, chars, symbols, lines, dup, repeat = c
        rules = {"word_length": not 3 * n <= chars <= 10 * n, "symbols": 10 * symbols > n, "dup_lines": 10 * dup > 3 * lines}
        base = n < 20 or 100 * repeat > 30 * n
        return base, rules, base or any(rules.values())

    hosts = {}
    for host, c in counted:
        if host is not None:
            base, rules, bad = fails(c)
            mine = hosts.setdefault(host, {"n": 0, "any": 0, **{r: 0 for r in rules}})
            mine["n"] += 1
            mine["any"] += bad
            for r, f in rules.items():
                mine[r] += f
    rates = {}
    for r in ("any", "word_length", "symbols", "dup_lines"):
        m, n, k = len(hosts), sum(h["n"] for h in hosts.values()), sum(h[r] for h in hosts.values())
        if not n:
            continue
        p, nn = k / n, sum(h["n"] ** 2 for h in hosts.values())
        if m < 2 or k in (0, n) or n - nn / n - (m - 1) <= 0:
            strength = 10.0
        else:
            s = sum(h["n"] * (h[r] / h["n"] - p) ** 2 for h in hosts.values())
            rho = (s - p * (1 - p) * (m - 1)) / (p * (1 - p) * (n - nn / n - (m - 1)))
            strength = 1 / min(max(rho, 1e-9), 1.0) - 1
        a, b = max(strength * p, 1e-9), max(strength * (1 - p), 1e-9)
        rates[r] = {host: (h[r] + a) / (h["n"] + a + b) for host, h in hosts.items()}
    out = []
    for host, c in counted:
        base, rules, _ = fails(c)
        rejected = host is not None and rates["any"][host] > host_rules.HOST_LIMIT
        suspect = host is not None and any(f and rates[r][host] > host_rules.SUSPECT_LIMIT for r, f in rules.items())
        out.append((base, not (base or rejected or suspect)))
    return out


def hosted(spark):
    """Hosts with good, bad and mixed documents, one of them with half of the rows."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8)))
    rows = []
    for i in range(400):
        host = "https://Big.example/x" if i % 2 else f"h{i % 14}"
        words = [word() for _ in range(40)]
        share = 0.9 if host == "h2" else 0.4 if host == "h4" else 0.03
        if r.random() < share:
            kind = r.randrange(4)
            words = ["#"] * 9 + words if kind == 0 else words[:5] if kind == 1 else (words[:10] * 5 if kind == 2 else [w * 9 for w in words])
        rows.append((i, "\n".join([" ".join(words[:20]), " ".join(words[20:])]), host))
    return rows


def test_host_rules_against_plain(spark):
    rows = hosted(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    named = ["big.example" if h.startswith("https") else h for _, _, h in rows]
    want = plain_verdicts(list(zip(named, [t for _, t, _ in rows])))
    got = {r.doc_id: r for r in host_rules.judged(df).collect()}
    for (i, text, _), host, (base, kept) in zip(rows, named, want):
        r = got[i]
        assert tuple(r[c] for c in host_rules.COUNTS) == plain_counts(text)
        assert (r.host, r.base_failed, r.kept) == (host, base, kept)
    rejected = {r.host for r in got.values() if r.host_rejected}
    assert rejected == {"h2"}
    assert all(got[i].kept for (i, _, _), h, (b, _) in zip(rows, named, want) if h == "big.example" and not got[i].failed_rules and not b)
    kept = host_rules.keep_documents(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_host_rules_on_edge_rows(docs, empty):  # noqa: F811
    got = host_rules.judged(docs).collect()
    assert len(got) == len(EXAMPLES) + 2
    for r in got:
        text = EXAMPLES[r.doc_id if r.doc_id is not None else 15]
        assert tuple(r[c] for c in host_rules.COUNTS) == plain_counts(text)
        if r.doc_id == 2:
            assert r.host is None
    kept = host_rules.keep_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r.doc_id) for r in got if r.kept)
    assert host_rules.judged(empty).count() == 0 and host_rules.keep_documents(empty).count() == 0


def test_repeated_words():
    r = random.Random(1)
    for n in (0, 7, 8, 9, 16, 40, 300):
        for letters in (1, 2, 50):
            words = [str(r.randrange(letters)) for _ in range(n)]
            assert host_rules.text_counts(" ".join(words))[-1] == plain_counts(" ".join(words))[-1]


def test_one_host_and_no_failures():
    assert host_rules.beta_prior({"m": 1, "n": 10.0, "k": 3.0, "nn": 100.0, "kkn": 0.9}) == (3.0, 7.0)
    a, b = host_rules.beta_prior({"m": 3, "n": 30.0, "k": 0.0, "nn": 300.0, "kkn": 0.0})
    assert a == 1e-9 and b == 10.0


# Whitening ---------------------------------------------------------------------


def check_whitened(got, rows, components=16):
    """Against numpy's eigenvectors of the covariance of the distinct rows."""
    whole = {i: tuple(int(math.floor(64 * c)) + 1_000_000 for c in v) for i, v in rows}
    x = np.array(sorted(set(whole.values())))
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1], directions[:, ::-1]
    k = min(components, int((values > 1e-12 * values.sum()).sum()))
    assert {(r.vec_id, r.component) for r in got} == {(i, c) for i in whole for c in range(1, k + 1)}
    projected = {i: (np.array(v) - sums / n) @ directions / np.sqrt(np.maximum(values, 1e-300)) for i, v in whole.items()}
    signs = {}
    for r in got:
        assert r.n == n and r.deviation == sum((n * a - int(s)) ** 2 for a, s in zip(whole[r.vec_id], sums))
        assert abs(r.explained * values.sum() - values[r.component - 1]) <= 1e-9 * values[0] and r.identity_error <= 1e-9
        gaps = [abs(values[r.component - 1] - values[j]) for j in (r.component - 2, r.component) if 0 <= j < len(values)]
        if min(gaps, default=1.0) > 1e-6 * values[0]:
            want = projected[r.vec_id][r.component - 1]
            if abs(want) > 1e-6:
                signs.setdefault(r.component, np.sign(want) * np.sign(r.whitened))
                assert np.isclose(r.whitened * signs[r.component], want, rtol=1e-6, atol=1e-8)


def test_whitening_against_eigenvectors(spark, small):
    got = queries.QUERIES["op12_whitening"](spark, small).collect()
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    check_whitened(got, rows)


@pytest.mark.parametrize("case", ["steep", "flat", "repeated", "narrow", "copies"])
def test_whitening_of_shapes(spark, case):
    r = np.random.default_rng(5)
    if case == "steep":
        v = r.normal(size=(300, 24)) * 0.5 ** np.arange(24) * 30
    elif case == "flat":
        v = r.normal(size=(400, 20))
    elif case == "repeated":  # every eigenvalue twice or more: ±1 on each axis
        v = np.vstack([np.eye(6), -np.eye(6)])
    elif case == "narrow":
        v = np.outer(r.normal(size=50), np.arange(1, 6)) * 10 // 1
    else:
        v = np.repeat(r.normal(size=(30, 9)), 7, axis=0)
    rows = [(i, [float(c) for c in x]) for i, x in enumerate(v)]
    got = whitening.whitened(vector_table(spark, [(i, x, "a") for i, x in rows])).collect()
    if case == "repeated":
        assert len(got) == 12 * 6 and all(abs(x.explained - 1 / 6) < 0.01 for x in got)
    check_whitened(got, rows)


def test_whitening_edges(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(c) for c in r.normal(size=4)], None) for i in range(20)]
    odd = [(90, None, "a"), (91, [1.0, None, 0.0, 0.0], "a"), (92, [1.0, float("nan"), 0.0, 0.0], "a"),
           (93, [1.0, float("inf"), 0.0, 0.0], "a"), (94, [], "a"), (95, [1.0, 2.0], "a")]
    df = vector_table(spark, rows + odd + [rows[3], (None, rows[4][1], "b")])
    got = whitening.whitened(df).collect()
    assert len(got) == 22 * 4 and {x.vec_id for x in got} == {None, *range(20)}
    check_whitened([x for x in got if x.vec_id is not None], [(i, v) for i, v, _ in rows])
    assert whitening.whitened(vector_table(spark, [])).count() == 0
    assert whitening.whitened(vector_table(spark, [(1, [1.0, 2.0], "a"), (2, [1.0, 2.0], "a")])).count() == 0
    wide = whitening.Fit(10**9, [10**15, 10**15], 0.0, np.zeros(0), np.zeros((0, 2)))
    assert wide.deviations(np.array([[10**6, 10**6], [10**6 + 1000, 10**6]])) == [0, None]


# Vector codes --------------------------------------------------------------------


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """rows: (vec_id, vector, label), usable ones only."""
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    rows = sorted([(i, [math.floor(256 * c) for c in v], label) for i, v, label in rows], key=key)
    x = np.array([v for _, v, _ in rows], dtype=object).reshape(len(rows), parts, -1)
    books = x[:entries].swapaxes(0, 1).copy()

    def assign():
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        return d.argmin(axis=2), d.min(axis=2)

    for _ in range(rounds):
        index, _ = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = x[index[:, p] == e, p]
                if len(mine):
                    books[p, e] = [int(s) // len(mine) for s in mine.sum(axis=0)]
    index, error = assign()
    labels = {}
    for (_, _, label), e in zip(rows, error):
        labels[label] = labels.get(label, 0) + int(e.sum())
    digest = hashlib.sha256(",".join(str(c) for c in books.ravel()).encode()).hexdigest()
    return sorted((str(i), "".join(f"{c:02x}" for c in row), int(e.sum()), labels[label], digest)
                  for (i, _, label), row, e in zip(rows, index, error))


def found_codes(df):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


def test_vector_codes_on_edge_rows(spark):
    r = np.random.default_rng(3)
    rows = [(int(i), [float(c) for c in r.normal(size=32)], None if i % 5 == 0 else f"l{i % 3}") for i in range(150)]
    rows += [(200 + i, rows[0][1], "l0") for i in range(120)] + [rows[7], (None, rows[8][1], ""), (None, rows[9][1], None)]
    rows += [(400 + i, [float(round(c)) for c in r.normal(size=32)], "ties") for i in range(60)]
    odd = [(1000, None, "a"), (-5, [1.0] * 31, "a"), (-4, [], "a"), (-3, [1e300] + [0.0] * 31, "a"), (-2, [float("nan")] * 32, "a"), (1001, [0.0] * 16, "a")]
    got = found_codes(pivots.compressed(vector_table(spark, rows + odd)))
    assert got == plain_codes(rows)
    few = rows[:20]
    assert found_codes(pivots.compressed(vector_table(spark, few))) == plain_codes(few)
    assert pivots.compressed(vector_table(spark, [])).count() == 0


def test_pivots_rule_out_most_entries():
    r = np.random.default_rng(6)
    x, book = r.integers(-200, 200, size=(3000, 4)), r.integers(-200, 200, size=(64, 4))
    fixed = pivots.spread_pivots(book, pivots.PIVOTS)
    index, best, evaluated = pivots.nearest_entries(x, pivots.roots(x, fixed), book, fixed)
    d = ((x[:, None, :] - book) ** 2).sum(axis=2)
    assert (index == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    assert evaluated < 0.2 * d.size
