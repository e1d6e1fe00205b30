import io
import sqlite3

import pytest
from hypothesis import given
from hypothesis import strategies as st

from rowsmith import tools
from rowsmith.api import query_csv, query_sqlite
from rowsmith.cli import main
from rowsmith.errors import HandlingError
from rowsmith.sources import csv, registry
from rowsmith.sources import dialect as D


def put(tmp_path, text, name="t.csv", encoding="utf-8"):
    p = tmp_path / name
    p.write_bytes(text.encode(encoding) if isinstance(text, str) else text)
    return str(p)


def rows(table):
    return [tuple(r)[:-1] for r in table.df.collect()]


@given(st.lists(st.text(alphabet='ab",; \t', max_size=6), min_size=1, max_size=5), st.sampled_from([",", ";", "\t", "##"]))
def test_quoted_round_trip(fields, delim):
    line = delim.join(D.quote(f, delim, "quoted") for f in fields)
    assert D.split(line, delim, "quoted") == (fields, False)


@pytest.mark.parametrize(
    ("line", "policy", "delim", "want"),
    [
        ('a,"b,c",d', "quoted", ",", (["a", "b,c", "d"], False)), ('"x""y", "sp" ,', "quoted", ",", (['x"y', "sp", ""], False)), ('a"b",c', "quoted", ",", (['a"b"', "c"], True)),
        ("a##b##", "simple", "##", (["a", "b", ""], False)), ("  a   b ", "whitespace", " ", (["a", "b"], False)), ('a,"b', "monocolumn", ",", (['a,"b'], False)), ('"a"x,b', "quoted", ",", (['"a"x', "b"], True)),
    ],
)
def test_dialects(line, policy, delim, want):
    assert D.split(line, delim, policy) == want


def test_reading(spark, tmp_path):
    t, w = csv.read(spark, put(tmp_path, "﻿name,n\r\n# no\r\n\"a,b\",1\r\nc\r\n"), has_header=True, comment_prefix="#")
    assert t.header == ["name", "n"] and rows(t) == [("a,b", "1"), ("c", None)]
    assert len(w) == 1 and "not consistent" in w[0]  # Spark's line reader drops a UTF-8 mark without a word
    assert "BOM" in csv.read(spark, put(tmp_path, b"\xef\xbb\xbfa,b\n"), encoding="latin-1")[1][0]
    assert rows(csv.read(spark, put(tmp_path, "a\tb\rc\td"), "TAB")[0]) == [("a", "b"), ("c", "d")]
    assert rows(csv.read(spark, put(tmp_path, "é;ü\n", encoding="latin-1"), ";", encoding="latin-1")[0]) == [("é", "ü")]
    assert rows(csv.read(spark, put(tmp_path, '1,"two\nlines"\n3,4\n'), policy="quoted_rfc")[0]) == [("1", "two\nlines"), ("3", "4")]
    assert "escaping" in csv.read(spark, put(tmp_path, 'a,b"c\nd,e\n'))[1][0]
    assert rows(csv.read(spark, put(tmp_path, ""))[0]) == []
    with pytest.raises(Exception, match="never closed"):
        csv.read(spark, put(tmp_path, '1,"two\n'), policy="quoted_rfc")
    for bad in ({"policy": "whitespace"}, {"policy": "odd"}, {"encoding": "utf-7"}):
        with pytest.raises(HandlingError):
            csv.read(spark, put(tmp_path, "a"), **bad)


def test_query_files(spark, tmp_path):
    a = put(tmp_path, "id,name,v\n1,x,1.50\n2,y,7\n3,\"p,q\",\n")
    put(tmp_path, "id,label\n1,one\n2,two\n", "b.csv")
    out = str(tmp_path / "out.csv")
    r = query_csv(spark, "select a.name, int(a.id) * 2, b.label, a.id == '1' left join b.csv on a.id == b.id order by a.id desc", a, has_header=True, output_path=out)
    assert open(out).read() == 'name,col2,label,col4\n"p,q",6,,False\ny,4,two,False\nx,2,one,True\n'
    assert r.warnings == ["None values in output were replaced by empty strings"]
    query_csv(spark, "select sum(a3), avg(a3), a2.split(',') where NR != 3 group by a2", a, has_header=True, output_path=out, output_delim="\t")
    assert open(out).read() == "col1\tcol2\tcol3\n1.5\t1.5\tx\n7.0\t7.0\ty\n"
    assert "separator" in query_csv(spark, "select a2", a, output_path=out, output_delim=",", output_policy="simple").warnings[-1]
    with pytest.raises(HandlingError, match="monocolumn"):
        query_csv(spark, "select a1, a2", a, output_path=out, output_policy="monocolumn", output_delim="\t")
    with pytest.raises(HandlingError, match="Unable to find"):
        query_csv(spark, "select a1 join none.csv on a1 == b1", a)


def test_sqlite_and_names(spark, tmp_path):
    db = str(tmp_path / "e.db")
    with sqlite3.connect(db) as c:
        c.execute("create table employee (emp_id integer, salary integer)")
        c.executemany("insert into employee values (?, ?)", [(1, 4500), (2, None), (3, 3000)])
    r = query_sqlite(spark, "select a.emp_id, a.salary // 1000 where a.salary is not None order by a.salary", db, output_path=str(tmp_path / "o"))
    assert open(tmp_path / "o").read() == "emp_id,col2\n3,3\n1,4\n" and r.warnings == []
    assert query_sqlite(spark, "select count(1) from employee", db).df.collect()[0][0] == 3
    with pytest.raises(HandlingError):
        registry.sqlite_table(spark, db, "x; drop")
    index = str(tmp_path / "names")
    registry.remember("mine", db, index)
    assert registry.find_path("mine", None, index) == db


def test_tools(spark, tmp_path):
    text = 'a, bb ,c\n"long one",x, yy\n'
    p = put(tmp_path, text)
    assert tools.lint(spark, p) is None and tools.detect(spark, p) == (",", "quoted")
    assert [r.value for r in tools.align(spark, p).collect()] == ["a          ,bb ,c", '"long one" ,x  ,yy']
    assert [r.value for r in tools.shrink(spark, p).collect()] == ["a,bb,c", '"long one",x,yy']
    assert "line 2 has 1 fields" in tools.lint(spark, put(tmp_path, "a,b\nc\nd,e\n"))
    assert "Line 2" in tools.lint(spark, put(tmp_path, 'a,b\nc"d,e\nf\n'))
    assert D.guess(["a|b", "c|d"]) == ("|", "simple") and D.guess(["x"], "f.tsv") == ("\t", "simple") and D.guess(["x", "y,z;;w"], "f.csv") == (";", "quoted")


def test_command_line(spark, tmp_path, capsys):
    p, out = put(tmp_path, "n,v\nx,1\ny,2\n"), io.StringIO()
    assert main(["--input", p, "--delim", ",", "--with-headers", "--query", "select a.n, int(a.v) + 1 as w where a.v == '2'", "--out-format", "tsv"], spark, out) == 0
    assert out.getvalue() == "n\tw\ny\t3\n"
    assert main(["--input", p, "--query", "select a1 where a1 = 2", "--error-format", "json"], spark, out) == 1
    assert '"query parsing"' in capsys.readouterr().err
    assert main(["--input", p, "--preview"], spark, out := io.StringIO()) == 0 and out.getvalue() == "n,v\nx,1\ny,2\n"
