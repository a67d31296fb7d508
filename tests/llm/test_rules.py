"""Quality rules, decontamination and license scans against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest
from conftest import FOLDER, WORD, folded, tricky_rows

from tessera.llm import decontamination, licenses, quality
from tessera.llm import queries as llm_queries

ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def measures(text: str | None) -> tuple:
    t = text or ""
    w, n = WORD.findall(t), len(WORD.findall(t))
    count = Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    repeated = {i + k for i in range(n - 2) if count[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    chars, symbols, dup = sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines))
    base = n < 50 or 100 * len(repeated) > 50 * n
    bad = 10 * symbols > n or 10 * sum("A" <= c <= "Z" for c in t) > 3 * len(t) or chars < 3 * n or chars > 10 * n or 2 * dup > len(lines)
    return n, chars, symbols, dup, len(repeated), base, not base and not bad


@pytest.mark.parametrize("scan", [16, 0])
def test_measures(tricky, monkeypatch, scan):
    monkeypatch.setattr(quality, "SCAN", scan)
    got = [tuple(r)[:8] for r in quality.score(tricky).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(((d, *measures(t)) for d, t in tricky_rows()), key=key)


def test_measures_of_documents(documents, pairs):
    assert sorted(tuple(r)[:8] for r in quality.score(documents).collect()) == [(d, *measures(t)) for d, t in pairs]


def test_order_changes_the_work_alone(documents):
    rules = quality.ordered(documents)
    assert sorted(r.name for r in rules) == sorted(r.name for r in quality.RULES)
    want = sorted(r.doc_id for r in quality.score(documents).filter("kept").collect())
    assert sorted(r.doc_id for r in quality.keep_good(documents).collect()) == want
    for order in (quality.RULES, quality.RULES[::-1]):
        failed = quality._of(documents["text"], lambda t, w: quality.first_failure(list(order), quality.Measures(t, w)))  # noqa: B023
        assert sorted(r.doc_id for r in documents.filter(failed.isNull()).select("doc_id").collect()) == want


def test_good_rows_keep_their_columns(tricky):
    kept = quality.keep_good(tricky)
    assert kept.columns == tricky.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((d, t) for d, t in tricky_rows() if measures(t)[-1])
    assert kept.select("_t").distinct().collect() == [("x",)]


def test_quality_is_native(documents):
    for df in (quality.score(documents), quality.keep_good(documents), licenses.scan(documents)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def leaks(rows, items, window=10):
    windows: dict = {}
    for i, t in items:
        w = ITEM_WORD.findall(folded(t or ""))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).update(() if i is None else (str(i),))
    out = []
    for d, t in rows:
        w, hit, found = ITEM_WORD.findall(folded(t or "")), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= x
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))


@pytest.mark.parametrize("block", [1 << 20, 1])
def test_leaks(spark, tricky, block):
    long = next(t for d, t in tricky_rows() if d == 40)
    items = [(9, "sAme line; here!"), (10, " ".join(long.split()[500:540])), (11, None), (12, "..."), (13, "one"), (13, "one"), (None, "the the"), (None, " ".join(long.split()[900:920])), (16, " ".join(long.split()[905:915])), (14, "tHe " * 9), (15, "x é <|endoftext|>")]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as digest")
    got = sorted((tuple(r) for r in decontamination.decontaminate(tricky, bench, block_bytes=block).collect()), key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
    assert got == leaks(tricky_rows(), items)
    kept = decontamination.keep_clean(tricky, bench)
    assert kept.columns == tricky.columns
    assert Counter(r.doc_id for r in kept.select("doc_id").collect()) == Counter(r[0] for r in got if not r[5])


def test_leaks_of_documents(spark, documents, pairs):
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    got = sorted(tuple(r) for r in decontamination.decontaminate(documents, bench).collect())
    assert got == leaks(pairs, [(r.item_id, r.text) for r in bench.collect()])
    assert any(r[5] for r in got)


def test_many_windows_over_the_same_common_words():
    """Memory and work follow the places, not places times windows."""
    import itertools
    import tracemalloc

    import numpy as np

    words = [f"w{i}" for i in range(10)]
    orders = itertools.islice(itertools.permutations(words), 0, 400_000, 200)
    index = decontamination.Index([(str(i), " ".join(o).encode()) for i, o in enumerate(orders)], 10)
    index.join_on(np.ones(len(index.vocabulary), np.int64))
    text = np.frombuffer(" ".join(words[(i * i + i // 7) % 10] for i in range(120_000)).encode(), np.uint8)
    spans = decontamination.ALNUM.spans(text, np.array([0, len(text)]))
    tracemalloc.start()
    decontamination._matches(index, text, *spans)
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()


def test_without_items(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.decontaminate(documents, none).filter("contaminated or n_hit > 0").count() == 0


def contained(rows, templates):
    cut = lambda x: (lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)])(re.findall("[a-z0-9]+", x.lower()))
    out: dict = {}
    for d, t in rows:
        s = cut(t or "")
        for k, body in templates.items():
            need = set(cut(body))
            size = licenses.size_class(len(need))
            for a in range(0, len(s), size):
                w = s[a : a + 2 * size]
                share = len(set(w) & need) / len(need)
                if share >= 0.75:
                    x = out.setdefault((d, k), [0, 1 << 60, 0])
                    x[:] = max(x[0], share), min(x[1], a + next(i for i, y in enumerate(w) if y in need)), x[2] + 1
    return {k: tuple(v) for k, v in out.items()}


def found(df):
    return {(r.doc_id, r.template): (r.containment, r.first_word, r.n_windows) for r in df.collect()}


def test_licenses_in_documents(documents, pairs):
    got = found(licenses.scan(documents))
    assert got and got == contained(pairs, licenses.TEMPLATES)


def test_licenses_with_edits(spark):
    rows = [(1, None), (2, ""), (3, "MIT")]
    for i, body in enumerate(licenses.TEMPLATES.values()):
        w = body.split()
        rows += [(100 + i, "some text before " + body.upper() + " and after"), (200 + i, "\n".join(w[: len(w) * 9 // 10])), (300 + i, " ".join(w[: len(w) // 3])), (400 + i, "word " * 400 + " ".join(x if j != len(w) // 2 else "other" for j, x in enumerate(w)))]
    rows += rows[-1:]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as s", "2 as start", "3 as template")
    want = contained(list(dict.fromkeys(rows)), licenses.TEMPLATES)
    got = found(licenses.scan(df))
    assert got.keys() == want.keys() and all(got[k][:2] == want[k][:2] for k in want)


def test_licenses_take_what_is_tricky(spark, tricky):
    mit, apache = licenses.TEMPLATES["MIT/grant"], licenses.TEMPLATES["Apache-2.0/header"]
    rows = [*tricky_rows(), (None, mit), (None, mit), (48, "word " * 50_000 + apache)]
    want = contained(list(dict.fromkeys(rows)), licenses.TEMPLATES)
    more = spark.createDataFrame(rows[-3:], "doc_id long, text string")
    assert len(want) >= 3 and found(licenses.scan(tricky.unionByName(more, allowMissingColumns=True))) == want


def test_templates_from_a_folder(spark, tmp_path):
    (tmp_path / "X-1.0.txt").write_text("these are the words\nof a licence of some length")
    templates = licenses.from_folder(spark, str(tmp_path))
    assert list(templates) == ["X-1.0/body"]
    df = spark.createDataFrame([(1, "here: These are the words of a licence of some length."), (2, "none of it")], "doc_id long, text string")
    assert [(r.doc_id, r.license) for r in licenses.scan(df, templates).collect()] == [(1, "X-1.0")]


def test_band_settings(documents):
    assert (1 - licenses.similarity()) ** licenses.bands() <= licenses.MISS
    with pytest.raises(ValueError):
        licenses.scan(documents, {"x/y": "too short"})


def test_nothing(spark, nothing):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert quality.score(nothing).count() == quality.keep_good(nothing).count() == licenses.scan(nothing).count() == 0
    assert decontamination.decontaminate(nothing, bench).count() == decontamination.keep_clean(nothing, bench).count() == 0


@pytest.mark.parametrize("name", list(llm_queries.oracle_sql()))
def test_oracle(spark, name):
    from oracle import compare

    compare(spark, llm_queries.queries()[name], llm_queries.oracle_sql()[name], FOLDER)


@pytest.mark.parametrize("one_id", [7, None])
def test_licenses_in_different_texts_of_one_id(spark, one_id):
    """Every text of an id is scanned: its windows are those of the texts under ids of their own."""
    from tessera.llm.license_templates import TEMPLATES

    texts = [f"{body} {tail}" for body in [TEMPLATES[k] for k in sorted(TEMPLATES)[:2]] for tail in ("first end", "other end")]
    count = lambda ids: Counter({r[0]: r[1] for r in licenses.scan(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")).groupBy("template").agg({"n_windows": "sum"}).collect()})
    apart = count(range(4))
    assert apart and count([one_id] * 4) == apart
