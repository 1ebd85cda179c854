import math
import random

from umbra.llm.language import identify, page_inputs

WORDS = {
    "en": "the and house water with these people have been from their which would about other".split(),
    "de": "der und haus wasser mit diesen leuten haben gewesen von ihren welche würde über andere".split(),
    "fr": "le et maison eau avec ces gens ont été depuis leurs quels serait propos autres".split(),
    "es": "el y casa agua con estas personas han sido desde sus cuales sería sobre otros".split(),
}


def corpus(n=400, seed=3):
    rng, rows = random.Random(seed), []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        text = " ".join(rng.choice(WORDS[lang]) for _ in range(rng.choice([3, 30, 80])))
        declared = lang if rng.random() < 0.9 else rng.choice([None, "en", "xx"])
        rows.append((i, text, declared, f"www.{lang}{i % 3}.example.{lang if lang != 'en' else 'com'}", lang))
    return rows


def test_planted_languages(spark):
    rows = corpus()
    noise = [(1000 + i, "".join(chr(random.Random(i + j).randrange(0x3041, 0x3090)) for j in range(200)), None, "x.example.jp", "und") for i in range(5)]
    df = spark.createDataFrame(rows + noise, "doc_id long, text string, lang string, source string, truth string")
    got = {r.doc_id: r for r in identify(df).collect()}
    right = sum(got[r[0]].lang == r[4] for r in rows)
    assert right >= 0.99 * len(rows) and sum(got[r[0]].kept for r in rows) >= 0.99 * len(rows)
    assert all(got[r[0]].lang == "und" and not got[r[0]].kept for r in noise)


def plain(rows, languages):
    """{id: (lang, confidence, text_lang)}: the posterior in plain Python."""
    names = [*languages, "und"]
    k, size = len(names), 1 << 14

    def grams(text):
        b = (text or "").lower().encode()
        return [((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761 % 2**32) >> 18 for i in range(len(b) - 2)]

    soft = lambda x: [math.exp(v - max(x)) / sum(math.exp(w - max(x)) for w in x) for v in x]
    counts = {n: {} for n in languages}
    for _, text, declared, _ in rows:
        for g in grams(text) if declared in counts else ():
            counts[declared][g] = counts[declared].get(g, 0) + 1
    log = lambda n, g: math.log((counts[n].get(g, 0) + 0.5) / (sum(counts[n].values()) + 0.5 * size)) if n != "und" else -math.log(size)
    docs, sums, whole = [], {}, [0.0] * k
    for i, text, declared, host in rows:
        g = grams(text)
        ll = [sum(log(n, x) for x in g) / max(len(g), 1) * min(len(g), 50) for n in names]
        host = host.lower() if host is not None else None
        keys = {"host": ("+" + host) if host is not None else "-", "domain": ("+" + ".".join(host.split(".")[-2:])) if host is not None else "-"}
        keys |= {"declared": declared} if declared else {}
        keys |= {"suffix": host.split(".")[-1]} if host and "." in host else {}
        docs.append((i, g, ll, soft(ll), keys))
        if g:
            whole = [a + b for a, b in zip(whole, soft(ll))]
            for kind in keys.items():
                sums[kind] = [a + b for a, b in zip(sums.get(kind, [0.0] * k), soft(ll))]
    share = [(w + 1) / (sum(whole) + k) for w in whole]
    out = {}
    for i, g, ll, r, keys in docs:
        if not g:
            out[i] = ("und", 0.0, "und")
            continue
        p = []
        for j in range(k):
            domain, host = sums[("domain", keys["domain"])], sums[("host", keys["host"])]
            base = (domain[j] + 50 * share[j] - r[j]) / (sum(domain) + 50 * sum(share) - 1)
            prior = (max(host[j] - r[j], 0) + 20 * base) / (sum(host) - 1 + 20)
            logs = 0.0
            for kind in ("declared", "suffix"):
                if kind in keys:
                    c = sums[(kind, keys[kind])]
                    logs += math.log((c[j] + 10 * sum(c) / sum(whole)) / (whole[j] + 10))
            p.append(ll[j] + math.log(max(prior, 1e-9)) + logs)
        out[i] = (names[p.index(max(p))], max(soft(p)), names[ll.index(max(ll))])
    return out


def test_against_a_plain_posterior(spark):
    rng = random.Random(12)
    hosts = ["www.Example.de", "shop.example.de", "a.fr", "b.a.fr", "localhost", None, "news.site.com", "www.site.com", "x.y.es"]
    rows = []
    for i in range(200):
        lang = rng.choice(list(WORDS))
        text = rng.choice([None, "", "ab"]) if i % 25 == 0 else " ".join(rng.choice(WORDS[lang]) for _ in range(rng.choice([1, 2, 4, 20])))
        rows.append((i, text, rng.choice([lang, lang, lang, "en", None, "xx"]), rng.choice(hosts)))
    rows += [(200 + i, *rows[i][1:]) for i in range(20)]  # repeated texts
    got = {r.doc_id: r for r in identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    want = plain(rows, ("en", "de", "fr", "es"))
    for i, (lang, confidence, text_lang) in want.items():
        assert math.isclose(got[i].confidence, confidence, abs_tol=1e-3), (i, got[i], want[i])
        assert (got[i].lang, got[i].text_lang) == (lang, text_lang) or confidence < 0.51


def test_ties_take_the_first_language(spark):
    rows = [(i, "abcabc", None, "h") for i in range(4)]
    for r in identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), ("en", "de")).collect():
        assert r.text_lang == r.lang == "en" and not r.kept


def test_odd_pages(spark):
    rows = [(1, "http://a.de/x", "<p>" + "der und haus mit " * 40_000, "x", 1), (None, None, None, None, 2), (2, "", "", "", 3), (3, "not an address", "<html lang=>no <b>end", "de", 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, lang string, source int")
    got = identify(page_inputs(df)).collect()
    assert len(got) == 4 and {r.doc_id for r in got} == {1, None, 2, 3}
    assert identify(page_inputs(df.limit(0))).count() == 0


def test_other_evidence_decides_where_the_text_does_not(spark):
    rows = [r for r in corpus() if r[4] in ("de", "fr")]
    rows += [(2000, "123 456", "de", "www.de0.example.de", ""), (2001, "123 456", "fr", "www.fr1.example.fr", ""), (2002, "123 456", None, "new.fr1.example.fr", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, truth string")
    got = {r.doc_id: r for r in identify(df, ("de", "fr")).collect()}
    assert got[2000].lang == "de" and got[2001].lang == got[2002].lang == "fr"
    # Against the text: one declaration and address can't turn a long text.
    df = spark.createDataFrame(rows + [(3000, " ".join(WORDS["de"] * 4), "fr", "www.fr1.example.fr", "")], "doc_id long, text string, lang string, source string, truth string")
    assert {r.doc_id: r for r in identify(df, ("de", "fr")).collect()}[3000].lang == "de"


def test_odd_rows(odd, none):
    rows = identify(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r.confidence <= 1 and r.lang for r in rows)
    empty = [r for r in rows if r.doc_id in (3, 4)]
    assert len(empty) == 2 and all(r.lang == "und" and not r.kept for r in empty)
    assert identify(none).count() == 0
    bare = odd.select("doc_id", "text")
    assert identify(bare).count() == odd.count()


def test_pages(spark):
    html = '<!DOCTYPE html><HTML class=a lang="fr-CA"><script>var a="<p>the";</script><body>Bonjour<!-- the --> &amp;<p>le monde</p>'
    row = page_inputs(spark.createDataFrame([(1, "https://user@www.site.example.fr:80/x?y", html), (2, None, None)], "page_id long, url string, html string")).collect()
    assert row[0].text.split() == ["Bonjour", "&amp;", "le", "monde"] and row[0].lang == "fr-CA" and row[0].source == "www.site.example.fr"
    assert row[1][1:] == (None, None, None)
