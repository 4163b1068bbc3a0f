"""Distillation against a plain version of the rules, one document at a time."""

import hashlib
import re
import time
from collections import defaultdict

import pytest

from docfiling import corpus
from docfiling.functions import text as T
from docfiling.operators import distill as D

PROSE = "This clause goes on and on without saying much at all about anything; it is here to take up room. "
CASES = [
    [""],
    ["MASTER AGREEMENT\n\nbetween Alpha LLC and Beta Inc\nEffective Date: January 5, 2024\n| a | b |\n| 1 | 2 |\nafter the table\n\n# notes:\nlast line. "],
    [PROSE * 60 + "\n\nInvoice No AB-1234 of 3/14/26, total USD 500\n\n" + PROSE * 90 + "tail without an end " * 120],
    [f"HEADER LINE\n\nPage body {k} {PROSE * 12}\n\nGOVERNING LAW\nThe law of {k} rules.\n\nPage {k} of 9" for k in range(1, 10)],
    ["| ALL CAPS TABLE |\nbody here\n| x |\nMORE CAPS\nbody again  \n   \n\tindented. " + "x" * 3000],
    [("Filed on 2021-02-03 by someone " + "word " * 40 + "\n") * 30, "second page Signature: /s/ X", "third"],
    ["é" * 800 + ". " + "Ünïcode; " * 200],
]


def split(value, most):
    if len(value) <= most:
        return [value]
    chunks, now, sentence = [], "", ""
    for c in value:
        sentence += c
        if c in ".!?;\n":
            if len(now) + len(sentence) > most and now:
                chunks.append(now)
                now = ""
            now += sentence
            sentence = ""
    now += sentence
    while len(now) > 2 * most:
        chunks.append(now[:most])
        now = now[most:]
    if now.strip():
        chunks.append(now)
    return chunks or [value]


def heading(line):
    t = line.strip()
    if not t or len(t) > 90:
        return False
    letters = [c for c in t if c.isalpha()]
    return t.startswith("#") or (not (t.endswith(".") and len(t.split()) > 6) and len(letters) >= 3 and sum(c.isupper() for c in letters) * 10 >= len(letters) * 8)


def signals(s):
    return sum(1900 <= int(y) <= 2199 for y in re.findall(r"[0-9]+", s) if len(y) == 4) + len(re.findall(r"(?<![0-9])[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2}(?![0-9])", s))


def cues(s, names):
    low = "".join(c.lower() if c.isascii() else c for c in s)
    return sum(c in low for c in names)


def mask(s):
    return re.sub("[0-9]+", "#", s).lower()


def plain(pages, budget, passthrough):
    blocks = []
    for page, text in enumerate(pages, 1):
        run, kind = [], None

        def flush(page=page):
            nonlocal run
            if run:
                blocks.extend({"page": page, "kind": kind, "text": c.rstrip()} for c in split("\n".join(run), 700) if c.strip())
            run = []

        for line in text.split("\n"):
            line = line.rstrip()
            now = "blank" if not line else "heading" if heading(line) else "table" if line.lstrip().startswith("|") else "body"
            if now != kind or now == "heading":
                flush()
            kind = now
            if now == "heading":
                blocks.append({"page": page, "kind": "heading", "text": line.strip()})
            elif now != "blank":
                run.append(line)
        flush()
    for k, b in enumerate(blocks):
        b["order"] = k
    if len(pages) >= 3:
        on = defaultdict(set)
        for b in blocks:
            if len(b["text"]) <= 120:
                on[mask(b["text"].strip())].add(b["page"])
        seen, left = set(), []
        for b in blocks:
            shape = mask(b["text"].strip())
            if len(b["text"]) > 120 or len(on[shape]) < max(len(pages) // 2, 3) or shape not in seen:
                left.append(b)
            seen.add(shape)
        blocks = left
    n = len(blocks)
    for i, b in enumerate(blocks):
        t = b["text"]
        c = {k: cues(t, v) for k, v in T.CUES.items()}
        d = signals(t)
        ident = any(
            len(re.findall("[A-Za-z]", w)) >= 2 and len(re.findall("[0-9]", w)) >= 2 and len(w.encode()) <= 24 for w in (re.sub("^[^0-9A-Za-z]+|[^0-9A-Za-z]+$", "", w) for w in t.split())
        )
        money = bool(re.search(r"(?s)[$£].{0,2}[0-9]|(?i:usd |eur )", t))
        head, opening, closing = b["kind"] == "heading", i < 4, i + 3 >= n
        b["score"] = (
            30 * d + 45 * c["date_role"] + 22 * c["party"] + 26 * c["type"] + 24 * c["subject"] + 14 * c["signature"] + 40 * head + 10 * (b["kind"] == "table") + 14 * ident + 8 * money
            + 60 * opening + 25 * closing + 12 * (b["page"] == 1) + 8 * (b["page"] == len(pages)) - 70 * (c["boilerplate"] > 0 and not head) - 8 * (len(t) < 25) - 6 * (len(t) > 400)
        )
        b["must"] = not c["boilerplate"] and bool(
            opening or c["date_role"] or (d and b["page"] == 1) or (c["party"] and c["type"]) or c["subject"] or (closing and c["signature"]) or (head and (c["type"] or d))
        )
        b["index"] = i
    source = sum(map(len, pages))
    kept = blocks
    if source > passthrough:
        kept, used, looks = [], 0, set()
        for b in sorted(blocks, key=lambda b: (-b["must"], -b["score"], b["order"])):
            look = mask(b["text"][:80])
            if not b["must"]:
                if look in looks:
                    continue
                looks.add(look)
            cost = len(b["text"]) + 2
            if used + cost > budget and kept:
                continue
            used += cost
            kept.append(b)
            if used >= budget:
                break
        kept.sort(key=lambda b: b["index"])
    dates = []
    for b in kept:
        for line in b["text"].split("\n"):
            for part in split(line, 150) if len(line) > 150 else [line]:
                part = part.strip()
                if part and signals(part) and part[:150] not in dates and len(dates) < 14:
                    dates.append(part[:150])
    outline = [h for h in (re.sub(":+$", "", b["text"].strip().lstrip("#").strip()) for b in blocks if b["kind"] == "heading") if h]
    out = ""
    if source > passthrough and outline:
        out += "SECTIONS: " + " | ".join(outline) + "\n\n"
    if len(dates) > 1:
        out += "EVERY DATE IN THIS DOCUMENT, WITH ITS OWN WORDS:\n" + "".join(f"- {d}\n" for d in dates) + "\n"
    last = None
    for b in kept:
        if last is None or b["page"] != last["page"]:
            out += ("\n" if last else "") + f"[Page {b['page']}]\n"
        elif last["index"] + 1 != b["index"]:
            out += "[...]\n"
        out += b["text"] + "\n\n"
        last = b
    return out.rstrip(), [b["text"] for b in kept], outline, dates


def compare(df, pages, budget, passthrough):
    got = D.distill(df, budget, passthrough).collect()
    assert {r["doc_id"] for r in got} == set(pages)
    for r in got:
        text, kept, outline, dates = plain(pages[r["doc_id"]], budget, passthrough)
        assert (r["text"], list(r["segments"]), list(r["outline"]), list(r["date_lines"])) == (text, kept, outline, dates), r["doc_id"]
        assert r["digest_characters"] == len(text) and r["source_characters"] == sum(map(len, pages[r["doc_id"]]))


@pytest.mark.parametrize("budget", [300, 2000, 12_000])
def test_cases(spark, budget):
    pages = {k: ps for k, ps in enumerate(CASES)}
    df = spark.createDataFrame([(k, n, t) for k, ps in pages.items() for n, t in enumerate(ps, 1)], "doc_id long, page_number int, text string")
    compare(df, pages, budget, budget)


@pytest.mark.parametrize("source", ["documents_as_pages", "statements", "conversations_as_pages"])
def test_tables(spark, sf_dir, source):
    df = getattr(corpus, source)(lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet"))
    pages = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: r["page_number"]):
        pages[r["doc_id"]].append(r["text"])
    compare(df, pages, 2000, 2000)


def test_order_of_rows_does_not_matter(spark, sf_dir):
    df = corpus.statements(lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet"))
    digest = lambda d: sorted((r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in D.distill(d, 1500, 1500).collect())
    assert digest(df) == digest(df.repartition(7, "text"))


def test_time_is_linear_in_a_document(spark):
    """One document of 32,000 paragraphs: the fill runs once, not for each block."""

    def seconds(n):
        text = "\n\n".join(f"Paragraph {k} of this long text says that item {k * 7 % 13} stands at place {k} since 19{k % 100:02d}." for k in range(n))
        df = spark.createDataFrame([(1, 1, text)], "doc_id long, page_number int, text string")
        began = time.time()
        (r,) = D.distill(df).collect()
        assert r["block_count"] == n and r["digest_characters"] <= D.BUDGET + 2000
        return time.time() - began

    seconds(250)
    few = seconds(250)
    assert seconds(8000) < few + 15 and seconds(32_000) < few + 40
    plan = D.distill(spark.createDataFrame([(1, 1, "x")], "doc_id long, page_number int, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"array_contains\(.*aggregate\(", plan)
