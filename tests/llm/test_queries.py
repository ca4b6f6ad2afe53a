"""The registered queries themselves, on the whole small tables: against SQL, or against plain versions."""

import hashlib
import math
import os
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from verdictlab.llm import queries, url_filter

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return c


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("select doc_id, text from documents").fetchall())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(str(r[c]) for c in cols) for r in df.collect()))
    r = duck.execute(queries.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(str(row[names.index(c)]) for c in cols) for row in r.fetchall())


def test_op1_learns_from_two_thirds_only(spark, duck):
    lang = dict(duck.execute("select doc_id, lang from documents").fetchall())
    got = queries.op1_language_id(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_op3_sizes_groups_and_slots(spark, texts):
    got = queries.op3_sharding(spark, SF).collect()
    size = np.zeros(8)
    slots, groups = defaultdict(list), defaultdict(set)
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        groups[raw].add(r["shard"])
    assert len(got) == len(texts) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert np.ptp(size) <= 0.02 * size.mean() and all(len(g) == 1 for g in groups.values())


ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def test_op5_base_spans(spark, texts):
    for r in queries.op5_secret_scan(spark, SF).collect():
        t = texts[r["doc_id"]] or ""
        found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
        kinds = [sum(k == i for _, k, _ in found) for i in range(3)]
        listed = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == kinds and r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(r["spans"].split(","))


def test_op7_rules_and_scores(spark, duck, monkeypatch):
    fitted = []
    fit = url_filter.fit
    monkeypatch.setattr(url_filter, "fit", lambda *a, **k: fitted.append(fit(*a, **k)) or fitted[-1])
    urls = dict(duck.execute("select page_id, url from pages").fetchall())
    got = queries.op7_url_filters(spark, SF).collect()
    assert sorted(r["page_id"] for r in got) == sorted(urls)
    w = fitted[0]
    for n, r in enumerate(got):
        u = urls[r["page_id"]] or ""
        rest = u.partition("://")[2] if "://" in u else ""
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [x for x in queries.URL_RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        rule = max(fits, key=lambda x: len(x.name), default=None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule.name)
        assert r["verdict"] == (rule.verdict if rule else "block" if r["p_block"] > 0.5 else "allow")
        if n < 50:
            assert r["p_block"] == pytest.approx(plain_score(host, path, w), abs=1e-5)


def plain_score(host, path, w):
    """Counts of hashed n-grams, one by one."""
    count = defaultdict(int)
    mask = (1 << 64) - 1
    for salt, text in ((1, host), (2, path)):
        c = [b + 1 for b in text.lower().encode()]
        for n in (3, 4, 5):
            for i in range(len(c) - n + 1):
                h = 0
                for x in c[i : i + n]:
                    h = (h * 257 + x) & mask
                z = (h + salt * 1000 + n + 0x9E3779B97F4A7C15) & mask
                z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & mask
                z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
                count[(z ^ (z >> 31)) & (url_filter.DIM - 1)] += 1
    length = math.sqrt(sum(v * v for v in count.values())) or 1
    return 1 / (1 + math.exp(-(sum(w[k] * v for k, v in count.items()) / length + w[-1])))
