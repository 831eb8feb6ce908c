"""Operator 12 against its SQL and on made-up texts."""

import duckdb
import pytest

from pagelake.llm import licenses

SCHEMA = "doc_id long, text string, crc string, template string, diagonal string, n string"
NOTICE = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
TEXTS = [
    None, "", " ,;", "mit", "MIT\tLicense", "the mit license. The MIT license!", "General Public License", "general public. general public license",
    "Licensed under the Apache License, Version 2.0.", "licensed under the apache software license version 2 0", NOTICE, NOTICE.replace("hereby", "now hereby").replace("any ", ""),
    "permission is hereby granted to nobody", "mit " * 3000 + "license", "mit license " * 4000, "é mit license ü", "mitélicense", "licensed under CC BY-NC 4.0", "apache license mit license general public license",
]


def rows(result, names):
    return sorted((tuple(r[n] for n in names) for r in result), key=repr)


@pytest.fixture(scope="module")
def both(spark):
    table = list(enumerate(TEXTS)) + [(None, NOTICE), (None, "mit license"), (40, "MIT\tLicense"), (40, "MIT\tLicense"), (40, "other")]
    df = spark.createDataFrame([(i, t, "c", "t", "d", "n") for i, t in table], SCHEMA).repartition(3)
    return table, {i: r for i, r in ((r["doc_id"], r) for r in licenses.scan(df).collect())}, df


def test_matches_sql(both):
    table, _, df = both
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", table)
    result = c.execute(licenses.oracle_sql())
    names = [d[0] for d in result.description]
    want = sorted(result.fetchall(), key=repr)
    assert rows(licenses.scan(df).collect(), names) == want


def test_places_and_labels(both):
    _, got, _ = both
    at = {t: got[i] for i, t in enumerate(TEXTS)}
    assert tuple(at["the mit license. The MIT license!"])[1:] == (6, 2, 1, 4, "mit", "mit", 1.0)
    assert tuple(at[""])[1:] == (0, 0, None, None, "", "", 0.0)
    assert at["mit " * 3000 + "license"]["first_word"] == 2999
    assert at["mit license " * 4000]["n_base"] == 4000
    assert (at["general public. general public license"]["n_base"], at["general public. general public license"]["first_word"]) == (1, 2)
    assert at[TEXTS[11]]["labels"] == "mit" and at[TEXTS[11]]["n_base"] == 0  # one word put in, one left out
    assert at["permission is hereby granted to nobody"]["labels"] == ""
    assert at["licensed under CC BY-NC 4.0"]["labels"] == "cc-by-nc"
    assert at["apache license mit license general public license"]["base_labels"] == "apache,gpl,mit"


def test_no_rows(spark):
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0
