"""Queries without SQL against plain versions, over the whole smallest tables."""

import re

from helpers import SF
from lodestrata import plans  # noqa: F401
from lodestrata.functions.text import MASKS
from lodestrata.operators.itinerary import FOLLOWS
from lodestrata.plans import registry


def rows_of_table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def test_masked_texts(spark):
    got = {r["doc_id"]: r for r in registry.QUERIES["masked_texts"](spark, SF).collect()}
    hits = 0
    for row in rows_of_table(spark, "documents"):
        text = row["text"]
        for name, pattern, place in MASKS:
            text, n = re.subn(pattern, place, text, flags=re.ASCII)
            assert got[row["doc_id"]][f"n_{name}"] == n, (row["doc_id"], name)
            hits += n
        assert got[row["doc_id"]]["masked"] == text
    assert hits > 10


def test_proposal_steps(spark):
    states, steps = list(FOLLOWS), {}
    for row in rows_of_table(spark, "events"):
        steps.setdefault(row["user_id"], []).append((row["event_id"], states[row["event_id"] % 6]))
    want = set()
    for user, own in steps.items():
        at = ""
        for n, state in sorted(own):
            ok = state == "proposed" if not at else at in FOLLOWS[state]
            at = state if ok else at
            want.add((user, n, state, ok))
    got = {(r["proposal_id"], r["n"], r["state"], r["valid"]) for r in registry.QUERIES["proposal_steps"](spark, SF).collect()}
    assert got == want


def test_circuit_breaker(spark):
    got = {r["event_id"]: r["state"] for r in registry.QUERIES["stream_circuit_breaker"](spark, SF).collect()}
    calls = {}
    for row in rows_of_table(spark, "events"):
        calls.setdefault(row["event_type"], []).append((row["ts"], row["event_id"], row["value"]))
    want = {}
    for own in calls.values():
        run, opened = 0, None
        for ts, ident, value in sorted(own):
            now = int(ts.timestamp())
            if opened is not None and now - opened < 60:
                want[ident] = "open"
                continue
            want[ident] = "closed" if opened is None else "half_open"
            if value is not None and value >= 60:
                run, opened = 0, None
            else:
                run += 1
                if opened is not None or run >= 5:
                    opened = now
    assert got == want and {"closed", "half_open"} <= set(want.values())


def test_heading_sections(spark):
    """Titles and bodies of each page's Markdown, cut at headings outside of fences."""
    from pyspark.sql import functions as F

    from lodestrata.operators import chunking

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    md = F.concat(F.lit("# "), chunking.html_title(F.col("html"), F.col("url")), F.lit("\n"), chunking.html_text(F.col("html")))
    texts = {r["page_id"]: r["md"] for r in pages.select("page_id", md.alias("md")).collect()}
    want = set()
    for page, text in texts.items():
        parts, fenced = [["", []]], False
        for raw in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
            line = raw.strip(" ")
            if re.match("```|~~~", line):
                fenced = not fenced
            elif not fenced and re.match(r"#{1,6}\s.+", line):
                parts.append([line, []])
            parts[-1][1].append(line)
        found = parts[1:]
        want |= {(page, i + 1, title, "\n".join(lines)) for i, (title, lines) in enumerate(found) if len(lines) > 1 or i + 1 == len(found)}
    got = {(r["doc_id"], r["part"], r["title"], r["content"]) for r in registry.QUERIES["heading_sections"](spark, SF).collect()}
    assert got == want


def test_dictionary_words_come_first(spark):
    from lodestrata.functions import text

    rows = spark.createDataFrame([(1, "call Li Wei 13812345678 or Li, a@b.cn"), (2, None), (3, "Wei")], "id int, t string")
    got = {r["id"]: r.asDict() for r in text.masked_rows(rows, "t", ("Li", "Li Wei")).collect()}
    assert got[1] == {"id": 1, "t": "call 〔敏感词〕 〔手机号〕 or 〔敏感词〕, 〔邮箱〕", "n_dict_word": 2, "n_id_card": 0, "n_bank_card": 0, "n_phone": 1, "n_email": 1, "n_money": 0}
    assert got[2]["t"] is None and got[2]["n_phone"] == 0 and got[3]["t"] == "Wei"
    whole, hits = text.masked("t", ("Li", "Li Wei"))
    assert rows.where("id = 1").select(whole).first()[0] == got[1]["t"]
