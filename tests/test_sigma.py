"""Rules against a plain interpreter of the same conditions."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from loglattice.functions import sigma

DDL = "k int, event_code int, process_name string, cmdline string, parent_name string, src_ip string, dst_port int"
ROWS = [
    (0, 1, "C:\\Windows\\powershell.exe", "ps -enc AAA", "winword.exe", "10.1.2.3", 443), (1, 4688, "cmd.exe", "curl https://dns.google/dns-query", None, "10.2.0.1", 53),
    (2, 1644, None, None, None, None, None), (3, 1, "C:\\a\\PWSH.EXE", "a -E x", "Excel.EXE", "192.168.0.9", 8080), (4, None, "", "a*b?c", "x", "10.1.255.255", 0), (5, 1, "b.exe", "  -enc", "y", "010.1.2.3.4", 99999),
]


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(ROWS, DDL)


def found(events, detection):
    return {r.k for r in events.filter(sigma.rule_column({"detection": detection})).collect()}


def test_conditions_follow_their_logic(spark):
    names = ["a", "b", "sel_x", "sel_y", "_hid"]
    table = spark.createDataFrame([(*bits,) for bits in itertools.product([True, False], repeat=5)], ", ".join(f"{n} boolean" for n in names))
    texts = [
        "a", "not a", "a and b", "a or b and not sel_x", "(a or b) and not sel_x", "not (a and b) or sel_y", "1 of sel_*", "all of sel_*", "1 of them", "all of them", "any of sel_* and not 1 of a*",
        "not not a", "((a))", "a and not (b or (sel_x and not sel_y)) or _hid", "all of s*_? or a", "NOT a AND b OR sel_x",
    ]

    def plain(text, row):
        def of(m):
            got = [row[n] for n in names if (not n.startswith("_") if m[2] == "them" else re.fullmatch(m[2].replace("*", ".*").replace("?", "."), n))]
            return str(all(got) if m[1] == "all" else any(got))

        text = re.sub(r"\b(1|all|any) of (\S+?)(?=[\s)]|$)", of, text)
        return eval(re.sub(r"\b(NOT|AND|OR)\b", lambda m: m[0].lower(), text), {}, row)  # the texts are those above

    cols = {n: F.col(n) for n in names}
    for r in table.select(*names, *[sigma.condition(t, cols).alias(f"c{k}") for k, t in enumerate(texts)]).collect():
        row = {n: r[n] for n in names}
        assert [r[f"c{k}"] for k in range(len(texts))] == [plain(t, row) for t in texts]


@pytest.mark.parametrize("text", ["", "a and", "(a", "a)", "a b", "1 of none*", "x", "a | count() > 3", "not"])
def test_other_conditions_are_refused(text):
    with pytest.raises(ValueError):
        sigma.condition(text, {"a": F.lit(True)})


def test_the_three_shapes_of_rules(events):
    powershell = {"selection": {"Image|endswith": ["\\powershell.exe", "\\pwsh.exe"], "CommandLine|contains": [" -enc ", " -e "]}, "condition": "selection"}
    assert found(events, powershell) == {0, 3}
    assert found(events, {"selection": {"CommandLine|contains": ["https://dns.google/dns-query"]}, "condition": "selection"}) == {1}
    assert found(events, {"selection": {"EventID": 1644}, "filters": {"CommandLine|contains": ["x"]}, "condition": "selection and filters"}) == set()
    nested = {"proc": {"EventID": [1, 4688]}, "sel_ps": {"Image|endswith": "powershell.exe"}, "sel_net": {"CommandLine|contains|all": ["curl", "dns"]}, "filter_office": {"ParentImage|startswith": "excel"}, "condition": "proc and (1 of sel_* or not filter_office) and not (filter_office and all of sel_*)"}
    assert found(events, nested) == {0, 1, 5}


def test_modifiers(events):
    one = lambda body: found(events, {"s": body, "condition": "s"})
    assert one({"SourceIp|cidr": "10.1.0.0/16"}) == {0, 4} and one({"SourceIp|cidr": ["10.2.0.0/24", "192.168.0.0/16"]}) == {1, 3}
    assert one({"DestinationPort|gt": 443}) == {3, 5} and one({"DestinationPort|lte": 53}) == {1, 4}
    assert one({"CommandLine|re": "^ps"}) == {0} and one({"Image": "*\\powershell.exe"}) == {0} and one({"Image": "?.EXE"}) == {5}
    assert one({"CommandLine": r"a\*b\?c"}) == {4} and one({"CommandLine|startswith": "a?b"}) == {4}
    assert one({"Image|cased|endswith": "EXE"}) == {3} and one({"Image|endswith": "EXE"}) == {0, 1, 3, 5}
    assert one({"Image": None}) == {2, 4} and one({"Image|exists": True}) == {0, 1, 3, 4, 5} and one({"Image|exists": False}) == {2}
    assert one([{"EventID": 1644}, {"Image": "cmd.exe", "DestinationPort": 53}]) == {1, 2} and one(["WINWORD", "nothing"]) == {0}
    assert found(events, {"s": {"Image": "cmd.exe"}, "condition": "not s"}) == {0, 2, 3, 4, 5}
    assert found(events, {"s": {"Image": "cmd.exe"}, "t": {"EventID": 1644}, "condition": ["s", "t"]}) == {1, 2}
    with pytest.raises(ValueError):
        one({"Image|base64offset": "x"})


def test_many_rules_in_one_pass(spark, events):
    rng = random.Random(0)
    rules = [{"title": f"r{k}", "level": "low", "tags": ["attack.t1059.001", "attack.execution"], "detection": {"s": {"DestinationPort|gte": rng.randrange(500)}, "condition": "s"}} for k in range(40)]
    got = sigma.matches(events, rules, keep=["k"]).collect()
    assert {(r.k, r.rule_title) for r in got} == {(e[0], r["title"]) for e in ROWS for r in rules if e[6] is not None and e[6] >= r["detection"]["s"]["DestinationPort|gte"]}
    assert {r.techniques for r in got} == {"T1059.001"}
    records = spark.sql("select parse_json('{\"EventID\": 1644, \"Details\": {\"Filter\": \"(admincount=1)\"}}') as record")
    rule = {"detection": {"a": {"EventID": 1644}, "b": {"Filter|contains": "admincount=1"}, "condition": "a and b"}}
    assert records.filter(sigma.rule_column(rule, sigma.record_field())).count() == 1


def test_yaml():
    pytest.importorskip("yaml")
    text = "title: a\ntags:\n  - attack.t1003\ndetection:\n  selection:\n    Image|endswith:\n      - '\\x.exe'\n  condition: selection\nlevel: high\n---\ntitle: no rule\n"
    (rule,) = sigma.load(text)
    assert sigma.techniques(rule) == ["T1003"] and rule["detection"]["selection"] == {"Image|endswith": ["\\x.exe"]}
