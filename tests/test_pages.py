"""Pages of services by the page writer."""

import os
from html import escape

import pytest

from schemasight import pages, sinks
from schemasight.operators import rules as R
from schemasight.registry import RULES

SERVICES = ["orders", "a b", "a_b", "x/y", "<b>&\"'"]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(s, f"src/<{s}>.sql", k, RULES[(k * 7) % len(RULES)].id) for s in SERVICES for k in range(1, 30)]
    df = spark.createDataFrame(rows, "service string, file_id string, line_no int, rule_id string").repartition(5)
    judged = R.configured(df, R.catalog(spark))
    gate = R.gate_with_total(judged, "service")
    return judged, gate


def test_a_page_a_service(spark, found, tmp_path):
    judged, gate = found
    out = str(tmp_path / "html")
    sinks.write_services(judged, gate, out)
    names = sorted(os.listdir(out))
    assert "index.html" in names and "service_orders_report.html" in names and len(names) == len(SERVICES) + 1 and not [n for n in names if n.startswith(".")]
    page = open(f"{out}/service_orders_report.html").read()
    assert page.count("<tr>") == 29 and page.count("<h2>") == page.count("<table>") == page.count("</table>") == len({r.category for r in judged.where("service = 'orders'").collect()})
    assert page.startswith("<!doctype html>") and "src/&lt;orders&gt;.sql" in page and "src/<" not in page
    index = open(f"{out}/index.html").read()
    assert index.count("<a href=") == len(SERVICES) and "<b>" not in index and "&lt;b&gt;&amp;" in index
    assert all(f'href="{escape(n)}"' in index for n in names if n != "index.html")
    sinks.write_services(judged, gate, out)  # again: pages are replaced
    assert sorted(os.listdir(out)) == names and open(f"{out}/service_orders_report.html").read() == page


def test_one_page(spark, found, tmp_path):
    judged, _ = found
    sinks.write_page(judged, R.gate(judged), str(tmp_path / "report.html"))
    assert os.listdir(tmp_path) == ["report.html"]
    text = open(tmp_path / "report.html").read()
    assert text.count("<tr>") == 29 * 5 and text.count("<tr>") == sinks.html_report(judged, R.gate(judged)).count("<tr>")
    sinks.write_page(judged.where("false"), R.gate(judged.where("false")), str(tmp_path / "empty.html"))
    assert "Passed" in open(tmp_path / "empty.html").read()


def test_a_failed_job_leaves_nothing(tmp_path):
    writer = pages.PageWriter(f"file://{tmp_path}")
    with pytest.raises(AttributeError):
        writer.write(iter([pages.Row(page="a", part=0, section="", html="x"), object()]))
    assert os.listdir(tmp_path)
    writer.abort([None])
    assert not os.listdir(tmp_path)
