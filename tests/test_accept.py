"""Order-dependent rules against row-by-row statements of them."""

import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import accept, dedupe, stats
from gleaner.queries.fixtures import ENTRIES

SCHEMA = "ordinal int, email string, website string, consent_status string, site_ordinal int"


def random_leads(rng, n):
    names, domains = ["info", "Max", "a.b", ""], ["x.de", "y.de", "z.com", "X.de"]
    rows = []
    for i in range(n):
        name = rng.choice(names)
        mail = f"{name}{rng.randrange(4)}@{rng.choice(domains)}" if name else ""
        rows.append((i, mail, f"https://www.{rng.choice(domains)}/", rng.choice(["business_public", "personal_review_required"]), i // 3))
    return rows


def plain_verdicts(rows, opt_out, ledger, seeds, by):
    out, seen, known = [], set(seeds), set(ledger or ())
    for i, mail, site, *_ in rows:
        domain = mail.partition("@")[2].lower() if "@" in mail else mail.lower()
        key = mail.strip().lower() if by == "email" else (mail.lower(), site.lower())
        if mail.lower() in opt_out or f"@{domain}" in opt_out or domain in opt_out:
            out.append((i, "suppressed"))
        elif ledger is not None and (mail.lower() in known or f"@{domain}" in known):
            out.append((i, "known"))
        elif not key or key in seen:
            out.append((i, "duplicate"))
        else:
            seen.add(key)
            out.append((i, "accepted"))
            known |= {mail.strip().lower(), f"@{domain}"}
    return out


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("ledger", [None, ("@y.de", "info1@z.com")])
def test_verdicts(spark, seed, ledger):
    rng = random.Random(seed)
    rows = [r for r in random_leads(rng, 60) if r[1] or ledger is None]
    opt_out, seeds = ("info2@x.de", "@z.com") if seed % 2 else ("x.de",), ("max1@x.de",)
    df = spark.createDataFrame(rows, SCHEMA)
    entries = lambda xs: spark.createDataFrame([(x,) for x in xs], "entry string")
    got = accept.verdicts(df, entries(opt_out), entries(ledger) if ledger else None, entries(seeds))
    assert sorted((r.ordinal, r.verdict) for r in got.collect()) == plain_verdicts(rows, opt_out, ledger, seeds, "email")
    if ledger is None:
        pairs = accept.verdicts(df, entries(opt_out), by="email_website")
        assert sorted((r.ordinal, r.verdict) for r in pairs.collect()) == plain_verdicts(rows, opt_out, None, (), "email_website")


@pytest.mark.parametrize("ledger", [None, ("@none.de",)])
def test_verdicts_on_ties(spark, ledger):
    rows = [(1, "a@x.de", "w"), (1, "a@x.de", "w"), (1, "A@x.de", "v"), (1, "b@y.de", "w"), (0, "b@y.de", "z"), (2, "out@x.de", "w")] * 2
    entries = lambda xs: spark.createDataFrame([(x,) for x in xs], "entry string")
    got = accept.verdicts(spark.createDataFrame(rows, "ordinal int, email string, website string").repartition(3), entries(["out@x.de"]), entries(ledger) if ledger else None).collect()
    assert len(got) == len(rows)
    assert sorted((r.ordinal, r.email) for r in got if r.verdict == "accepted") == [(0, "b@y.de"), (1, "A@x.de")]
    assert {r.verdict for r in got if r.email != "out@x.de"} == {"accepted", "known" if ledger else "duplicate"} and sum(r.verdict == "suppressed" for r in got) == 2


@pytest.mark.parametrize("most,already", [(0, 0), (1, 0), (5, 0), (5, 3), (100, 0)])
def test_cap_by_site(spark, most, already):
    rng = random.Random(most)
    rows = [(i, f"a{i}@x.de", "", "", rng.randrange(12) * 7_000) for i in range(25)]
    kept, count = set(), already
    for n, site in enumerate(sorted({r[4] for r in rows})):
        if n and count >= most:
            break
        kept.add(site)
        count += sum(r[4] == site for r in rows)
    got = accept.cap_by_site(spark.createDataFrame(rows, SCHEMA), most, already)
    assert sorted(r.ordinal for r in got.collect()) == sorted(r[0] for r in rows if r[4] in kept)


def plain_entries(rows):
    seen, out = set(), []
    from gleaner.sources.directories import entry_email, own_website

    for name, website, *_, email, _phone, i in rows:
        site, mail = own_website(website), entry_email(email)
        key = f"url:{site.lower().rstrip('/')}" if site else f"email:{mail}" if mail else ""
        if key and key not in seen:
            seen.add(key)
            seen |= {f"email:{mail}"} if site and mail else set()
            out.append(i)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_entries_to_results(spark, seed):
    rng = random.Random(seed)
    rows = [tuple(v.replace("{i}", "") if isinstance(v, str) else v for v in r) for r in ENTRIES] if seed == 0 else [("n", rng.choice(["", "a.example", "https://A.example/", "b.example", "yelp.de"]), "s", "", rng.choice(["", "x@a.example", "X@a.example", "bad"]), "", i) for i in range(14)]
    df = spark.createDataFrame(rows, "name string, website string, source_url string, snippet string, email string, phone string, ordinal int")
    assert sorted(r.ordinal for r in dedupe.entries_to_results(df).collect()) == plain_entries(rows)
    assert dedupe.entries_to_results(df, 2).count() == min(2, len(plain_entries(rows)))


@pytest.mark.parametrize("seed", range(3))
def test_round_robin(spark, seed):
    rng = random.Random(seed)
    groups = [[rng.choice(["", "https://a.de", "https://A.de/", "https://b.de", "https://c.de"]) for _ in range(rng.randrange(6))] for _ in range(3)]
    rows = [(s, i, u) for s, g in enumerate(groups) for i, u in enumerate(g)] or [(0, 0, "https://a.de")]
    groups = [[u for t, _, u in rows if t == s] for s in range(3)]
    want, seen = [], set()
    for turn in range(6):
        for g in groups:
            if turn < len(g) and (k := g[turn].lower().rstrip("/")) not in seen:
                seen.add(k)
                want.append(g[turn])
    df = spark.createDataFrame(rows, "source_rank int, ordinal int, url string")
    assert [r.url for r in dedupe.round_robin(df, 4).collect()] == want[:4]
    assert {r.url for r in dedupe.round_robin(df).collect()} == set(want)


def test_lists_and_ledgers(spark, tmp_path):
    from gleaner import sinks

    (tmp_path / "list.txt").write_text("# comment\n\n Max@X.de \n@y.de\nmax@x.de\n")
    own = accept.lines(spark.read.text(str(tmp_path / "list.txt")))
    assert sorted(r.entry for r in own.collect()) == ["@y.de", "max@x.de"]
    leads = spark.createDataFrame([("Max@x.de",), ("a@y.de",), ("a@sub.y.de",)], "email string")
    assert sorted(r.email for r in accept.not_suppressed(leads, own).collect()) == ["a@sub.y.de"]
    path = str(tmp_path / "ledger")
    assert sinks.read_ledger(spark, path) is None
    sinks.append_ledger(leads, path)
    sinks.append_ledger(leads, path)
    assert sorted(r.entry for r in sinks.read_ledger(spark, path).collect()) == ["@sub.y.de", "@x.de", "@y.de", "a@sub.y.de", "a@y.de", "max@x.de"]


def test_rates():
    assert [stats.per_minute(25, 100), stats.per_minute(1, 0), stats.per_minute(1, 240)] == [15.0, 0.0, 0.2]


def test_first_wins_prunes_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, ""), (4, None)], "ordinal int, k string")
    own = dedupe.first_wins(df, F.col("k"), "ordinal")
    assert [r.ordinal for r in own.collect()] == [1]
    assert "WindowGroupLimit" in own._jdf.queryExecution().executedPlan().toString()
