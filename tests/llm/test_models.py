"""URL tree, co-training, mixing: against brute force and held-out labels; the registry and the pipeline."""

import importlib.util
import os
import random
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import corpus_pipeline

sys.path.insert(0, str(Path(__file__).resolve().parent))
from lectern.llm import cotrain, soft_mixing, url_tree
from lectern.llm.queries import MIX_TARGETS, ORACLE, QUERIES, URL_RULES

PAGE = "page_id long, url string, host string, path string, template string, html string"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "h", "p", "t", "x") for i, u in urls], PAGE)


def brute_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:end], rest[end:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def brute_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = ["http://A.example.COM/en/712?x=/de/#y", "https://x.example.net/de/85", "https://x.example.net/de/75", "https://b.org/es/1", "noscheme.com/en/1", None, "", "http://h", "http://h?q=/en/", "http://com/en/9", "http://xcom/en/9", "ftp://q.com:80/en/1", "http://p.com/en/://x", "http://É.Example.com/EN/1"]


def test_urls_against_brute_force(spark):
    rows = list(enumerate(URLS)) + [(None, URLS[0]), (0, URLS[0])]
    got = url_tree.judge_urls(pages(spark, rows), URL_RULES).collect()
    assert len(got) == len(rows)
    want = {str((i, *brute_split(u), brute_rule(*brute_split(u))[0])) for i, u in rows}
    assert {str((r.id, r.host, r.path, r.rule)) for r in got} == want
    assert all(r.verdict == brute_rule(r.host, r.path)[1] for r in got if r.rule) and {r.verdict for r in got} == {"allow", "block"}
    assert url_tree.judge_urls(pages(spark, []), URL_RULES).count() == 0


def test_template_tree(spark):
    r, rows, marks = random.Random(5), [], []
    for i in range(600):
        kind = i % 4
        url = [f"http://h.x/shop/{r.randint(1, 10**6)}", f"http://h.x/user{i}/posts", f"http://h.x/a/{r.choice(['p', 'q'])}/1.html", f"http://other.x/shop/{i}"][kind]
        rows.append((i, url))
        marks.append((i, kind == 0 and r.random() < 0.95))
    labels = spark.createDataFrame(marks, "id long, bad boolean")
    got = {x.id: x for x in url_tree.judge_urls(pages(spark, rows), [], labels).collect()}
    assert {got[i].template for i in range(0, 600, 4)} == {"/shop/{num}"} and all(got[i].verdict == "block" for i in range(0, 600, 4))
    assert all(got[i].verdict == "allow" for i in range(600) if i % 4)
    assert {got[i].template for i in range(1, 600, 4)} == {"/{any}/posts"} and {got[i].template for i in range(2, 600, 4)} == {"/a/{like:p}/{num}.html"}
    own = {k: [m for m, (i, _) in zip(marks, rows) if (got[i].host, got[i].template) == k] for k in {(x.host, x.template) for x in got.values()}}
    rate = sum(b for _, b in marks) / len(marks)
    for x in got.values():
        mine = own[(x.host, x.template)]
        assert x.purity == pytest.approx((sum(b for _, b in mine) + 10 * rate) / (len(mine) + 10))


def test_merging_is_by_rate_and_shape(spark):
    """Branches of one shape merge with those of a like rate only; deep and unlabelled paths are their own templates."""
    r, rows, marks = random.Random(6), [], []
    for i in range(900):
        branch, rate = [("a", 0.9), ("b", 0.85), ("c", 0.1), ("d", 0.12), ("e", 0.9)][i % 5]
        rows.append((i, f"http://h.x/{branch}/{i}" if branch != "e" else f"http://h.x/e/name/{i % 7}x/y"))
        marks.append((i, r.random() < rate))
    deep = "/".join(f"s{k}" for k in range(40))
    rows += [(1000, f"http://h.x/{deep}"), (1001, f"http://q.x/{deep}"), (1002, "http://q.x/" + "v/" * 400)]
    got = {x.id: x for x in url_tree.judge_urls(pages(spark, rows), [], spark.createDataFrame(marks, "id long, bad boolean")).collect()}
    assert [{got[i].template for i in range(k, 900, 5)} for k in range(4)] == [{"/{like:a}/{num}"}] * 2 + [{"/{like:c}/{num}"}] * 2
    assert {got[i].verdict for i in range(0, 900, 5)} == {"block"} and {got[i].verdict for i in range(2, 900, 5)} == {"allow"}
    assert got[1001].template == "/" + deep and got[1002].template == "/v" * 400 and got[1001].verdict == "allow"


def test_op8_against_brute_force(spark, sf_dir):
    """Every column of the registered query that its contract fixes, and the evidence that verdicts of unruled pages need."""
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = QUERIES["op8_url_tree"](spark, sf_dir).collect()
    assert sorted(r.page_id for r in got) == sorted(urls)
    for r in got:
        host, path = brute_split(urls[r.page_id])
        rule, verdict = brute_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict)
        if rule is None:
            assert r.verdict == ("block" if r.evidence and r.purity >= 0.7 else "allow")


def test_unruled_pages_need_evidence(spark):
    """The rate of all labels is 0.9: it blocks nothing by itself."""
    urls = [f"http://a.com/en/{i}" for i in range(90)] + [f"http://a.com/de/{i}" for i in range(100, 110)] + [f"http://c.net/it/{i}" for i in range(30)]
    marks = [(i, i < 90) for i in range(100)] + [(i, i < 102) for i in range(100, 130)]
    more = ["http://b.org/en/5", "http://b.org/fr/5", "http://a.com/fr/5", "http://b.org/it/5", "http://a.com/en/page", "http://b.org/de/5", None, "http://b.org", "http://b.org/en/x/y"]
    rows = list(enumerate(urls + more))
    got = {r.id: r for r in url_tree.judge_urls(pages(spark, rows), [], spark.createDataFrame(marks, "id long, bad boolean")).collect()}
    new = [(got[i].evidence, got[i].verdict) for i in range(len(urls), len(rows))]
    none = (None, "allow")
    assert new == [("hosts", "block"), none, none, ("hosts", "allow"), ("parent", "block"), none, none, none, ("hosts", "block")]
    assert {got[i].evidence for i in range(130)} == {"own"}


DOC = "doc_id long, text string, lang string, source string, n_chars long, s string, __x int"


def corpus(spark, n=400, seed=1):
    r = random.Random(seed)
    vocabulary = {"en": "the of and to in is that for it as".split(), "de": "der die und in den von zu das mit sich".split()}
    rows, labels = [], []
    for i in range(n):
        lang = r.choice(["en", "en", "en", "de"])
        words = [r.choice(vocabulary[lang]) + r.choice(["", "", "x", "y"]) for _ in range(r.randint(20, 120))]
        junk, toxic = r.random() < 0.2, r.random() < 0.2
        if junk:
            words = [w + "%%%" for w in words]
        if toxic and not junk:
            words[r.randrange(len(words))] = r.choice(["vile", "filth", "scumbag"])
        rows.append((i, " ".join(words), lang, f"src{i % 5}", 0, "s", 1))
        labels.append((i, int(not junk), int(toxic and not junk)))
    return spark.createDataFrame(rows, DOC), labels


def test_cotraining_on_held_out_labels(spark):
    docs, labels = corpus(spark)
    known = spark.createDataFrame(labels[:250], "doc_id long, quality int, toxic int")
    got = {r.id: r.kept for r in cotrain.score_documents(docs, known).collect()}
    right = [got[i] == bool(q and not t) for i, q, t in labels[250:]]
    assert len(got) == 400 and sum(right) > 0.95 * len(right)
    kept = cotrain.keep_good(docs, known)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}


def test_cotraining_cases(spark):
    docs, labels = corpus(spark, 40)
    odd = docs.limit(0).union(spark.createDataFrame([(1, None, None, None, None, None, None), (None, "", "en", "a", 1, "", 1), (2, "x " * 30_000, "en", "a", 1, "", 1), (2, "x", "en", "a", 1, "", 1)], DOC))
    none = spark.createDataFrame([(None, 1, 0), (77, 0, 1)], "doc_id long, quality int, toxic int")
    assert all(r.kept for r in cotrain.score_documents(odd, none).collect())
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert cotrain.score_documents(docs.limit(0), known).count() == 0
    one_class = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(1, None, 0)], "doc_id long, quality int, toxic int")
    assert all(r.kept and r.low_quality == 0 for r in cotrain.score_documents(docs.union(odd), one_class).collect())


def test_mixing_meets_targets(spark):
    docs, _ = corpus(spark)
    ids = docs.select("doc_id")
    for lower, share in ((0.0, 0.3), (1.0, 0.5)):
        rows = soft_mixing.mix(docs, ids, {"en": 1 - share, "de": share}, lower=lower).collect()
        assert len(rows) == 400 and all(r.rate >= lower and abs(r.copies_out - r.rate) < 1 for r in rows)
        assert all(abs(sum(r.posterior) - 1) < 1e-9 for r in rows)
        de = rows[0].domains.index("de")
        got = sum(r.rate * r.tokens * r.posterior[de] for r in rows) / sum(r.rate * r.tokens for r in rows)
        assert got == pytest.approx(share, abs=0.02)
    langs = {r.doc_id: r.lang for r in docs.collect()}
    assert sum(rows[0].domains[max(range(2), key=lambda k: r.posterior[k])] == langs[r.id] for r in rows) > 390
    out = soft_mixing.apply_mix(docs, ids, {"en": 0.5, "de": 0.5})
    assert out.columns == docs.columns and out.select("doc_id").distinct().count() == 400
    assert out.count() == sum(r.copies_out for r in soft_mixing.mix(docs, ids, {"en": 0.5, "de": 0.5}).collect())


@pytest.mark.parametrize("have", [(0.75, 0.12, 0.10, 0.03), (0.90, 0.08, 0.015, 0.005), (0.62, 0.13, 0.15, 0.10)])
def test_rates_meet_targets_of_small_domains(spark, have):
    want = [0.5, 0.2, 0.15, 0.15]
    rows = [(1000 * h, *(float(i == j) for j in range(4))) for i, h in enumerate(have)]
    got = soft_mixing.fit_rates(spark.createDataFrame(rows, "tokens double, p0 double, p1 double, p2 double, p3 double"), want, 1.0).collect()
    mass = [r.rate * r.tokens for r in got]
    assert [m / sum(mass) for m in mass] == pytest.approx(want, abs=0.002) and min(r.rate for r in got) >= 1


def test_rates_against_projected_gradient(spark):
    """The same objective, minimised by plain projected gradient steps over the rates themselves."""
    import numpy as np

    r = np.random.default_rng(3)
    tokens, p = r.integers(5, 400, 40).astype(float), r.dirichlet([0.4, 0.4, 0.4], 40)
    shares = np.array([0.5, 0.3, 0.2])
    rows = spark.createDataFrame([(float(t), *map(float, q)) for t, q in zip(tokens, p)], "tokens double, p0 double, p1 double, p2 double")
    got = np.array([x.rate for x in soft_mixing.fit_rates(rows, shares.tolist(), 1.0).collect()])
    have = tokens @ p
    total = max(have / shares)
    mass = tokens[:, None] * p
    loss = lambda rate: float((((rate @ mass) - shares * total) ** 2).sum()) / total**2
    rate, step = np.ones(40), 0.5 / np.linalg.norm(mass, 2) ** 2
    for _ in range(20_000):
        rate = np.maximum(1.0, rate - 2 * step * mass @ (rate @ mass - shares * total))
    assert got.min() >= 1 and loss(got) <= loss(rate) + 1e-5


def test_rates_out_of_reach_are_reported(spark):
    rows = spark.createDataFrame([(10.0, 0.9, 0.1), (10.0, 0.8, 0.2)], "tokens double, p0 double, p1 double")
    with pytest.warns(UserWarning, match="can't meet"):
        got = soft_mixing.fit_rates(rows, [0.1, 0.9], 1.0).collect()
    assert all(r.rate >= 1 for r in got)
    with pytest.raises(RuntimeError, match="did not settle"):
        soft_mixing.fit_rates(rows, [0.1, 0.9], 1.0, max_steps=1)


def test_mixing_cases(spark):
    docs, _ = corpus(spark, 30)
    odd = docs.union(spark.createDataFrame([(None, "the of", "en", "a", 1, "", 1), (500, None, None, None, None, None, None), (501, "", "en", "a", 1, "", 1), (502, "a a", "en", "", 1, "", 1), (502, "a a", "en", "", 1, "", 1)], DOC))
    ids = docs.select("doc_id")
    rows = soft_mixing.mix(odd, ids, MIX_TARGETS).collect()
    assert len(rows) == 35 and sum(r.id == 502 and r.tokens == 2 for r in rows) == 2 and {r.tokens for r in rows if r.id in (500, 501)} == {0}
    assert soft_mixing.mix(docs.limit(0), ids, MIX_TARGETS).count() == 0
    assert {r.rate for r in soft_mixing.mix(docs, ids.limit(0), MIX_TARGETS).collect()} == {1.0}
    assert {r.rate for r in soft_mixing.mix(docs, ids, {"zz": 1.0}).collect()} == {1.0}


def test_no_python_in_native_plans(spark, sf_dir):
    for name in ("op6_soft_mixing", "op8_url_tree", "op9_content_sort"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
        assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "MapIn")), name


def test_op9_against_sql(spark, sf_dir):
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from compare import canonical, connect, spark_rows, sql_rows

    got, want = spark_rows(QUERIES["op9_content_sort"](spark, sf_dir)), sql_rows(connect(sf_dir), ORACLE["op9_content_sort"])
    assert canonical(got, sorted(want[0])) == canonical(want, sorted(want[0]))


def test_registry():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 11)) and set(ORACLE) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5


def test_pipeline_stages_against_their_decisions(spark, sf_dir):
    """Each stage keeps just the rows that its operator's own result says; the last one counts the ids of what is left."""
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    from lectern.llm.common import cut, table
    from lectern.llm.decontaminate import words_of
    from lectern.llm.queries import vocabulary

    first = table(spark, sf_dir, "documents")
    docs, states = first, [first]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "test")
        assert docs.columns == first.columns
        states.append(docs)
    ids = [sorted(r.doc_id for r in s.select("doc_id").collect()) for s in states]
    scores = cotrain.score_documents(first, table(spark, sf_dir, "labels"))
    assert ids[1] == sorted(r.id for r in scores.where("kept").collect())
    from test_dedup import brute_similar

    rows = sorted((r.doc_id, r.text) for r in states[1].collect())
    least = {rows[k][0]: rows[root][0] for k, root in enumerate(brute_similar([t for _, t in rows]))}
    gone = set(ids[1]) - set(ids[2])
    like = {i for i, first in least.items() if i != first}
    assert gone <= like and len(gone) >= 0.9 * len(like) > 5
    items = [b" ".join(words_of(r.text)) for r in table(spark, sf_dir, "benchmark").collect()]
    windows = {b" " + b" ".join(w[k : k + 10]) + b" " for t in items for w in [t.split()] for k in range(max(1, len(w) - 9)) if w}
    clean = sorted(r.doc_id for r in states[2].collect() if not any(w in b" " + b" ".join(words_of(r.text)) + b" " for w in windows))
    assert ids[3] == clean
    assert set(ids[4]) == set(ids[3])  # rates are one at least
    got = corpus_pipeline.run(spark, sf_dir).collect()
    whole = Tokenizer.from_file(vocabulary())
    texts = {r.doc_id: r.text for r in states[4].collect()}
    assert sorted(r.doc_id for r in got) == ids[4]
    for r in got:
        own = np.array(whole.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2], "<u4")
        assert (r.n_tokens, r.ids_crc32) == (len(own), zlib.crc32(own.tobytes()))


def test_rest_works_without_this_subpackage(tmp_path):
    """The registry imports when the folders and the pipeline are gone, or can't be imported, and has the other queries."""
    root = Path(importlib.util.find_spec("lectern").origin).parent.parent
    shutil.copytree(root / "lectern", tmp_path / "lectern", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), sum(n[:2] == 'op' and n[2].isdigit() or n == 'pipeline' for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0, out.stderr
    total, ours = map(int, out.stdout.split()[-2:])
    assert total > 30 and ours == 0
    (tmp_path / "lectern" / "llm").mkdir()
    (tmp_path / "lectern" / "llm" / "__init__.py").write_text("")
    (tmp_path / "lectern" / "llm" / "queries.py").write_text("import a_library_that_is_not_there\n")
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0 and list(map(int, out.stdout.split()[-2:])) == [total, 0], out.stderr


@pytest.mark.parametrize("names", [("__score", "a.b"), ("__n", "__again"), ("Row", "score"), ("rate", "copies_out")])
def test_rows_with_any_names(spark, names):
    """Classifier and mixing carry every column as it is."""
    docs, labels = corpus(spark, 40)
    docs = docs.select("doc_id", "text", "lang", "source", *(docs["doc_id"].alias(n) for n in names))
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = cotrain.keep_good(docs, known)
    mixed = soft_mixing.apply_mix(docs, docs.select("doc_id"), {"en": 0.5, "de": 0.5})
    assert kept.columns == mixed.columns == docs.columns
    for out in (kept, mixed):
        rows = [tuple(r) for r in out.collect()]
        assert rows and all(r[4] == r[5] == r[0] for r in rows)


def test_pipeline_stages_on_odd_tables(spark, sf_dir):
    """Empty tables, nulls in every column, extra columns: each stage returns its input's columns."""
    from lectern.llm.common import cut

    wide = "doc_id long, text string, lang string, source string, n_chars long, row int, `a.b` string"
    odd = [(1, "x " * 50_000, "en", "s", 1, 1, "p"), (1, "x " * 50_000, "en", "s", 1, 1, "p"), (2, None, None, None, None, None, None), (None, "some words here", "de", "t", 3, 3, "q"), (3, "", "en", "", 0, 0, "")]
    for rows, least in ((odd, 3), ([], 0)):
        docs = spark.createDataFrame(rows, wide)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = cut(stage(spark, docs, sf_dir), "test")
            assert out.columns == docs.columns and out.count() >= least
            docs = out
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()
