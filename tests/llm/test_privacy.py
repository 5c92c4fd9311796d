"""Spans against regular expressions over whole texts, and the disclosure rule."""

import hashlib
import math
import re

import edge
import pytest
from idsift.llm import privacy

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        return 16 <= len(d) <= 19 and total % 10 == 0
    return kind != "phone" or 8 <= len(d) <= 15


def base(text):
    out = []
    for kind, pattern in BASE.items():
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text or "") if valid(kind, m.group())]
    return out


TEXTS = [
    "mail a.b@c-d.example.com, b@c.d.e_f@g.h and x@y plus @z.de", "a@b.cc@d.ee@f.g.h", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.2.3.255",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 5500000000000004", "+49 (30) 1234567 +1 2 +12345678901234567",
    "😀 é +44 20 7946 0958 😀 bob@x.yz 10.0.0.1", "1 2 3 " * 2000, "7" * 30_000, "a" * 30_000 + "@", "x@" * 5000, ("q@r.st " * 3000),
    "1." * 20_000, "+1(" * 3000, "...@a.b%c@d.e", "card 4111 1111 1111 1111 4111 1111 1111 1111",
]


def test_base_spans(spark):
    texts = TEXTS + [r[1] for r in edge.rows()[:17]]
    df = edge.with_clashes(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    found = {r["doc_id"]: r for r in privacy.find(df).collect()}
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        want = base(t)
        r = found[i]
        for kind in BASE:
            assert r[f"n_{kind}"] == sum(k == kind for k, *_ in want), (kind, (t or "")[:60])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), (t or "")[:60]
        assert r["spans"].startswith(text)


def people():
    """Names that stand by one address, a common word that stands by all, and others."""
    docs = []
    for i in range(60):
        name = ["Quillfeather", "Brambleton", "Ottershaw"][i % 3]
        mail = f"{name[:3].lower()}@mail.example.com"
        docs.append(f"Number {i}: please write to {name} at {mail} about thing{i} soon.")
    docs += [f"please write about something else {i}" for i in range(200)]
    return docs


def test_terms_that_disclose(spark):
    docs = people()
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in privacy.find(df).collect()}
    for i, t in enumerate(docs):
        terms = [t[int(a) : int(b)] for k, a, b in (s.split(":") for s in found[i]["spans"].split(",") if s) if k == "term"]
        assert terms == ([["Quillfeather", "Brambleton", "Ottershaw"][i % 3]] if i < 60 else []), t
        assert found[i]["n_term"] == len(terms)
    clean = {r["doc_id"]: r["text"] for r in privacy.sanitise(df).collect()}
    assert clean[0] == "Number 0: please write to  at [EMAIL] about thing0 soon."
    assert clean[100] == docs[100]


def test_disclosure_figures(spark):
    df = privacy.keyed(spark.createDataFrame(list(enumerate(people())), "doc_id long, text string"))
    ids = df.select("_id", "_key", "text")
    found = privacy.entities(ids)
    told = privacy.Revealing(ids, privacy.holding(ids), privacy.mentions(found)).disclosures()
    got = {(r["entity"], r["term"]): r["disclosure"] for r in told.collect()}
    n, c, t, both = 260, 20, 20, 20
    assert got["email:qui@mail.example.com", "quillfeather"] == pytest.approx(math.log2(both * n / (c * t)) / math.log2(n / c))


def terms_of(text, row):
    return [text[int(a) : int(b)] for k, a, b in (s.split(":") for s in row["spans"].split(",") if s) if k == "term"]


def test_terms_far_from_the_entity(spark):
    far = "this goes on and on without saying anything at all of note " * 5
    docs = [f"Dear Quillfeather, {far} {i} write to q@mail.example.com {far} Quillfeather" for i in range(6)]
    docs += [f"{far} nobody {i}" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in privacy.find(df).collect()}
    clean = {r["doc_id"]: r["text"] for r in privacy.sanitise(df).collect()}
    for i in range(6):
        assert terms_of(docs[i], found[i]).count("Quillfeather") == 2
        assert "Quillfeather" not in clean[i]
    assert all(found[i]["n_term"] == 0 and clean[i] == docs[i] for i in range(6, 66))


@pytest.mark.parametrize("name", ["Anna", "anna_92", "C-20417", "31.12.1987", "娜", "x" * 60, "O’Hara", "Zoe\u0308y"])
def test_terms_of_any_form(spark, name):
    forms = [f"({name}", f'"{name}"', f"[{name}]", f"{name}/", f"{name}!"]
    docs = [f"ask {forms[i]} at q@mail.example.com for thing{i}" for i in range(5)]
    docs += [f"ask at nobody for something{i}" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in privacy.find(df).collect()}
    for i, text in enumerate(docs):
        assert terms_of(text, found[i]) == ([name] if i < 5 else [])


def test_repeated_rows_with_entities_and_terms(spark):
    docs = list(enumerate(people()))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    copied = df.unionByName(df.filter("doc_id in (0, 4, 70)")).unionByName(df.filter("doc_id = 0")).repartition(3)
    once = {r["doc_id"]: tuple(r) for r in privacy.find(df).collect()}
    rows = privacy.find(copied).collect()
    assert len(rows) == len(docs) + 4
    assert {tuple(r) for r in rows} == set(once.values())
    clean = {(r["doc_id"], r["text"]) for r in privacy.sanitise(df).collect()}
    assert {(r["doc_id"], r["text"]) for r in privacy.sanitise(copied).collect()} == clean
    one = spark.createDataFrame([(1, "write to a@b.example now")] * 6, "doc_id long, text string")
    assert [(r["n_email"], r["spans"]) for r in privacy.find(one).collect()] == [(1, "email:9:20")] * 6


def test_a_long_list_of_addresses_is_one_pair(spark):
    contacts = " ".join(f"Name{i} a{i}@mail.example.com," for i in range(1500))
    docs = [(1, contacts + " first"), (2, contacts + " second")] + [(i, f"nothing here {i}") for i in range(3, 90)]
    df = privacy.keyed(spark.createDataFrame(docs, "doc_id long, text string")).select("_id", "_key", "text")
    revealing = privacy.Revealing(df, privacy.holding(df), privacy.mentions(privacy.entities(df)))
    assert revealing.pairs.count() == 1 and revealing.entity_groups.count() == 1500
    assert revealing.told().filter("term like 'name%'").count() == 3000


def test_edge_rows(spark):
    docs = edge.docs(spark)
    assert privacy.find(docs).count() == len(edge.rows())
    clean = privacy.sanitise(docs)
    assert clean.columns == docs.columns and clean.count() == len(edge.rows())
    assert privacy.find(edge.empty(spark)).count() == 0
    assert privacy.sanitise(edge.empty(spark)).count() == 0
