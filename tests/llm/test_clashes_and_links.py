"""Input columns called like results, and the query over a real link graph."""

from __future__ import annotations

import random

import duckdb
import pandas as pd
import pytest

from corvane.llm import decontam, langid, licenses, linededup, simhash, urlfilter

NAMES = "kept n_lines n_dropped gone drop line body k did mark first n lang_pred score rejected judged _judged row sentence_ids licenses scan n_words n_hit item_ids spans items found hit id fp bands sig _salt".split()


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    words = [f"{a}{b}o" for a in "bcdfghk" for b in "aeiou"]
    rows = []
    for i in range(40):
        text = "\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(3)) + ("\nA line that many share" if i % 3 == 0 else "")
        rows.append((i, text, "xy"[i % 2] * 2, "s", len(text), *[f"{c}-{i}" for c in NAMES]))
    rows.append((40, None, None, None, None, *[None] * len(NAMES)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in NAMES))


def test_filters_keep_columns_of_any_name(spark, docs):
    bench = spark.createDataFrame([(1, "A line that many share with no one else at all here")], "item_id long, text string")
    held = {r.doc_id: r for r in docs.collect()}
    for stage in (linededup.without_repeated_lines, langid.keep_identified, simhash.keep_one, lambda d: decontam.clean(d, bench), lambda d: decontam.clean(d, bench, shard_words=5)):
        out = stage(docs)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows
        for r in rows:
            assert all(r[c] == held[r.doc_id][c] for c in NAMES)


def test_results_overwrite_columns_of_their_names(spark, docs):
    bench = spark.createDataFrame([(1, "A line that many share")], "item_id long, text string")
    found = {
        ("kept", "n_lines", "n_dropped"): linededup.dedup_lines(docs),
        ("lang_pred", "score", "rejected"): langid.identify(docs, langid.fit(docs)),
        ("sentence_ids", "licenses"): licenses.scan_licenses(docs),
        ("n_words", "n_hit", "item_ids"): decontam.scan(docs, decontam.automata(bench)),
    }
    for names, out in found.items():
        assert out.columns == [c for c in docs.columns if c not in names] + list(names)
        assert out.select(*names).count() == 41
    assert {r.n_hit for r in found["n_words", "n_hit", "item_ids"].collect()} == {0, 5}


def test_propagation_over_a_link_graph_against_sql(spark):
    rng = random.Random(5)
    hosts = [f"h{i}.{rng.choice(['org', 'net', 'com', 'de'])}" for i in range(60)] + ["example.org", "a.com", "sub.example.org"]
    rows = []
    for i in range(700):
        html = "".join(f'<a href="https://{rng.choice(hosts)}/q">x</a> <A class=b HREF=//{rng.choice(hosts)}>y</A>' for _ in range(rng.randrange(4)))
        rows.append((i, f"http://{rng.choice(hosts)}{rng.choice(['/x', '/fr/1', '/de/2', '/es/', '/en/1', ''])}", html if i % 9 else None))
    rows += [(900, None, "<a href='http://a.com'>"), (901, "a.com/de/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    con = duckdb.connect()
    frame = pages.toPandas()
    con.register("pages", frame)
    got = sorted(map(str, map(tuple, urlfilter.digest(pages).collect())))
    assert got == sorted(map(str, con.execute(urlfilter.digest_sql()).fetchall()))
    by_method = [r for r in urlfilter.judge_urls(pages).collect() if r.rule is None and r.host]
    assert {r.verdict for r in by_method} == {"allow", "block"}


def test_mass_of_a_small_host_does_not_depend_on_the_table(spark):
    """One blocked page, a thousand hosts that link to it: all of them are blocked, with few seeds or many elsewhere."""
    link = lambda h: f'<a href="http://{h}/">x</a>'
    local = [(0, "http://bad.com/de/1", None)] + [(k, f"http://f{k}.net/", link("bad.com") + link("other.net") * 50) for k in range(1, 200)]
    for many in (0, 3000):
        far = [(10_000 + k, f"http://x{k % 7}.com/de/{k}", None) for k in range(many)] + [(50_000, "http://good.org/", None)]
        out = urlfilter.judge_urls(spark.createDataFrame(local + far, "page_id long, url string, html string"))
        got = {r.page_id: r for r in out.where("page_id between 1 and 199").collect()}
        assert {r.verdict for r in got.values()} == {"block"} and {r.distrust > 0 for r in got.values()} == {True}


def test_hosts_of_many_pages_and_links_are_split(spark, monkeypatch):
    """Salted hosts keep every page and link: the same rows with a salt for every three links and ten thousand pages."""
    rows = [(k, f"https://hub.net/{k}", "".join(f'<a href="https://h{k % 40 + j}.net/">x</a>' for j in range(3))) for k in range(12_000)]
    rows += [(20_000 + k, f"https://h{k}.net/", f'<a href="https://{"example.org" if k % 2 else "hub.net"}/es/">y</a>') for k in range(42)]
    rows += [(30_000 + k, f"https://example.org/{'es' if k % 3 else 'fr'}/{k}", None) for k in range(9)] + [(40_000, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    want = sorted(map(str, urlfilter.judge_urls(pages).collect()))
    monkeypatch.setattr(urlfilter, "LINKS", 3)
    got = sorted(map(str, urlfilter.judge_urls(pages).collect()))
    assert got == want and len(got) == len(rows)
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    exact = sorted(str(r) for r in con.execute(urlfilter.digest_sql()).fetchall())
    assert sorted(str(tuple(r)) for r in urlfilter.digest(pages).collect()) == exact
