"""License places against a plain scan, verified notices, and edge rows."""

import re

from tidemark.llm.licenses import NOTICES, PHRASES, license_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(p, label) for p in range(len(w)) for body, label in PHRASES if w[p:p + len(body.split())] == body.split()]
    return (len(w), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None),
            ",".join(sorted({label for _, label in places})))


def test_places_labels_and_edges(spark):
    mit = NOTICES[2][1]
    cut = " ".join(mit.split()[:20] + ["really"] + mit.split()[20:])
    rows = [(1, "Released under the MIT License. MIT-license, mit  LICENSE!"), (2, "the GNU General Public License and the general public"),
            (3, None), (4, ""), (5, "!!"), (None, "Apache License here"), (6, "İ mit licensé, mit\nlicense"), (7, cut.upper()),
            (8, "Licensed under CC BY-NC 4.0."), (9, "word " * 50_000 + "apache license"), (1, "no words of law"), (8, "Licensed under CC BY-NC 4.0."),
            (10, "MIT Apache License General Public License MIT License"), (11, "mit license " * 300)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, labels string")
    got = license_scan(df).collect()
    key = lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in r)
    assert sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], key=key) == \
        sorted([(i, *plain(t)) for i, t in rows], key=key)
    labels = {}
    for r in got:
        assert 0 <= r.score <= 1 and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
        labels.setdefault(r.doc_id, set()).add(r.labels)
    assert labels[7] == {"mit"} and labels[8] == {"cc-by-nc"} and labels[10] == {"apache,gpl,mit"} and labels[1] == {"mit", ""}
    assert labels[3] == labels[4] == labels[5] == {""}


def test_no_rows_and_no_python(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    out = license_scan(df)
    assert out.count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))
