"""License scans: plain Python for the base phrases, hand cases for notices; no Python in the plan."""

import re

from lectern.llm.licenses import BASE, scan_licenses


def brute(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    at = [(i, label) for p, label in BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


TEXTS = [
    "Released under the MIT License.",
    "the MIT-License and the mit license, mit license",
    "GNU General Public GNU general public license apache\nlicense",
    "Kit MIT licenſe",
    "MİT license CC-BY 4.0 cc by",
    "gnu general public",
    "Licensed under CC BY-NC 4.0.",
    "permission is hereby granted, free of charge, to any one person obtaining a copy of this software and its associated documentation files",
    "é mit license é",
    None,
    "",
    "mit",
]


def test_base_and_notices(frame):
    df = frame(list(enumerate(TEXTS)))
    got = {r.doc_id: r for r in scan_licenses(df).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), t
        assert 0 <= r.score <= 1 and (r.score == 1 or not r.n_base) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert got[0].labels == "mit,mit-release" and got[6].labels == "cc-by,cc-by-nc" and got[7].labels == "mit-notice"


def test_native_and_odd(odd, empty):
    df = scan_licenses(odd)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert df.count() == odd.count() and scan_licenses(empty).collect() == []
