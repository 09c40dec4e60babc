"""Personal-data spans on lines written by hand, apart from the templates that the trees learn from."""

import pytest

pii = pytest.importorskip("caselode.llm.pii")

TRUE = [
    ("email", "you can get me under john at example.com most days", "john at example.com"),
    ("email", "john [at] example [dot] com", "john [at] example [dot] com"),
    ("email", "Her address: maria.lopez (at) uni-koeln (dot) de, please", "maria.lopez (at) uni-koeln (dot) de"),
    ("email", "send the papers to office AT lawyers DOT org today", "office AT lawyers DOT org"),
    ("email", "billing @ shop-example.net answers quickly", "billing @ shop-example.net"),
    ("email", "it was k.smith{at}gmail.com who asked", "k.smith{at}gmail.com"),
    ("email", "for the tickets, peter_77 [at] mail.example.co.uk", "peter_77 [at] mail.example.co.uk"),
    ("ip", "ip 2001:db8:85a3:0:0:8a2e:370:7334", "2001:db8:85a3:0:0:8a2e:370:7334"),
    ("ip", "the router answered from fe80::1ff:fe23:4567:890a again", "fe80::1ff:fe23:4567:890a"),
    ("ip", "traffic came from 2001:0db8:0000:0000:0000:ff00:0042:8329 at night", "2001:0db8:0000:0000:0000:ff00:0042:8329"),
    ("ip", "block 203[.]0[.]113[.]77 at the firewall", "203[.]0[.]113[.]77"),
    ("phone", "phone me: (415) 555-2671 after six", "(415) 555-2671"),
    ("phone", "my mobile is 0151 23456789", "0151 23456789"),
    ("phone", "telephone 212-555-0187, ask for Ann", "212-555-0187"),
    ("phone", "ring 0044 207 946 0958 from abroad", "0044 207 946 0958"),
    ("phone", "fax 030 1234 5678 or come by", "030 1234 5678"),
    ("card", "she paid by visa 4111.1111.1111.1111 yesterday", "4111.1111.1111.1111"),
    ("card", "card no 5500_0000_0000_0004 was refused", "5500_0000_0000_0004"),
    ("card", "transfer it to DE89 3704 0044 0532 0130 00 by Friday", "DE89 3704 0044 0532 0130 00"),
    ("card", "his social security number is 078-05-1120", "078-05-1120"),
]
FALSE = [
    "we met at noon.then we left",
    "he looked at me.What a day",
    "the meeting is at home dot nobody came",
    "ISBN 978-3-16-148410-0 is out of print",
    "order 2023 456 7890 was shipped",
    "version 4:12:7:33 of the build",
    "the score was 21 340 567 points",
    "std::vector and std::map are containers",
    "part 555-12-3456 is in stock",
    "see release 10.0.19041.1288 for fixes",
    "time 12:30:45:10 on the tape",
    "lot 1234.5678.9012.3456 expired",
    "serial AB12 3456 7890 1234 on the label",
    "invoice 123-456-7890 is due",
    "chapter 12.4.300.9 explains",
    "ratio 3:4:5:6 of sand",
    "a table of 1234 5678 9012 3456 rows",
    "the years 1999 2000 2001 were wet",
]


def test_lines_written_by_hand(spark):
    rows = [(i, kind, line, body) for i, (kind, line, body) in enumerate(TRUE)] + [(100 + i, None, line, None) for i, line in enumerate(FALSE)]
    out = pii.find_spans(spark.createDataFrame(rows, "i int, kind string, text string, body string")).collect()
    hit = [r for r in out if r.kind and any(s.kind == r.kind and s.body == r.body for s in r.spans)]
    wrong = [(r.text, [s.body for s in r.spans]) for r in out if any(s.body != r.body for s in r.spans)]
    missed = [r.text for r in out if r.kind and r not in hit]
    assert len(hit) >= 0.9 * len(TRUE), missed
    assert len(hit) / (len(hit) + len(wrong)) >= 0.9, wrong


def test_base_spans_win_over_added_ones(spark):
    rows = [("+49 151 2345678 4111 1111 1111 1111",), ("a@b.cd at example.com",), ("4111 1111 1111 1111 0044 207 946 0958",)]
    for r in pii.find_spans(spark.createDataFrame(rows, "text string")).collect():
        base = {(s.start, s.stop) for s in r.base}
        for s in r.spans:
            if (s.start, s.stop) not in base:
                assert all(s.stop <= a or s.start >= b for a, b in base)
        assert set(map(tuple, r.base)) <= set(map(tuple, r.spans))


def test_generators_propose_base_like_forms(spark):
    rows = [("order 4111 1111 1111 1112, mail a@b.cd, +1 23 45",)]
    got = pii.candidates(pii.base_spans(spark.createDataFrame(rows, "text string"))).select("proposed").first().proposed
    assert {"4111 1111 1111 1112", "a@b.cd"} <= {x.body for x in got}
