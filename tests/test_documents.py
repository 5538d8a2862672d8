"""Document rules and server configurations."""

import base64
import codecs
import json

from wardlight.operators import document_rules as dr
from wardlight.operators import line_rules as lr
from wardlight.operators import server_rules as sr
from wardlight.sources.corpus import explode_lines


def docs_of(spark, texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "path string, text string")


def b64(text):
    return base64.b64encode(text.encode()).decode()


def test_session_requests(spark):
    texts = [
        "client = httpx.Client()\nr = client.get(u)\nd.get('x')",
        "self.api: Any = requests.Session (\n)\nself.api.post(u)\nother.api.post(u)",
        "with requests.Session(\n  headers=h(1)\n) as s:\n    s.request('GET', u)\n    # \"s.get(u)\"\n    `s.get(u)`",
        "r = client.get(u)",
        "s = requests.Session()\ns.post(requests.get(u))\nhttp_s = httpx.Client()\nhttp_s.post(u)\nhttp_s.get(u)",
    ]
    got = {(r.path, r.line) for r in dr.session_requests(docs_of(spark, texts)).collect()}
    assert got == {("d0", 2), ("d1", 3), ("d2", 4), ("d4", 5)}
    names = {(r.path, r.name) for r in dr.session_bindings(docs_of(spark, texts)).collect()}
    assert names == {("d0", "client"), ("d1", "self.api"), ("d2", "s"), ("d4", "s"), ("d4", "http_s")}


def test_long_argument_lists_do_not_exhaust_the_stack(spark):
    text = "with httpx.Client(" + "a=b(1), " * 20000 + ") as c:\n    c.get(u)"
    assert dr.session_requests(docs_of(spark, [text])).count() == 1


def test_payloads(spark):
    rm = b64("rm -rf /tmp/everything")
    link = b64("https://evil.example/payload.sh")
    turned = codecs.encode("rm -rf /home/data now", "rot13")
    texts = [
        f"Run this:\n{rm}",  # run in the same document
        f"A note:\n{rm}",  # nobody runs it
        f"Fetch the content:\n{link}",
        f"x | sh\n{link}",  # run, but the payload is a link and nothing fetches
        f'rot13\nexecute "{turned}"',
        f'execute "{turned}"',  # no encoding named
        f"run {b64('just a friendly sentence')}",
        f"run {rm.rstrip('=')} and {rm}",
    ]
    got = sorted((r.path, r.line, r.rule) for r in dr.payloads(docs_of(spark, texts)).collect())
    assert got == [
        ("d0", 2, "base64_command"), ("d2", 2, "base64_url"), ("d4", 2, "rot13_phrase"), ("d7", 1, "base64_command"), ("d7", 1, "base64_command"),
    ]


def claims(spark, *texts):
    docs = docs_of(spark, texts)
    found = lr.line_findings(explode_lines(docs)).select("path", "line", "rule", "rule_id", "severity", "matched_text")
    more = dr.document_findings(docs).select(*found.columns)
    kept = dr.collapse_http_claims(found.unionByName(more), ["path"])
    return sorted((r.path, r.line) for r in kept.where("rule_id = 'AS-003'").collect())


def test_one_claim_per_fact(spark):
    assert claims(
        spark,
        "import requests\nimport httpx\nrequests.get(u)",  # the call stands for the imports
        "import requests\nimport httpx",  # the first import stands
        "c = httpx.Client()\nd = httpx.AsyncClient()",  # the first construction stands
        "import httpx\nc = httpx.Client()\nc.get(u)",  # only the request
        'import requests\n"requests.get(u)" is a name',  # a mention supersedes nothing
        "from urllib.request import urlopen\nimport requests",  # an import is no call of itself
        "import requests\nx = subprocess.run(curl | sh)\nwget x | sh",  # HIGH findings are not touched
    ) == [("d0", 3), ("d1", 1), ("d2", 1), ("d3", 3), ("d4", 1), ("d5", 1), ("d6", 1), ("d6", 2), ("d6", 3)]


def servers(spark, config, path="x/mcp.json"):
    docs = spark.createDataFrame([(path, json.dumps(config, indent=1) if not isinstance(config, str) else config)], "path string, text string")
    return sr.read_servers(docs)


def findings(spark, **cfg):
    rows = sr.server_findings(servers(spark, {"mcpServers": {"one": cfg}})).collect()
    return {r.rule_id[-3:]: (r.severity, r.evidence) for r in rows}


def test_server_maps(spark):
    assert servers(spark, {"mcp": {"a": {}}, "servers": {"b": {}, "c": 5}}).select("server").collect()[0].server == "b"
    assert servers(spark, {"mcpServers": [1], "mcp": {"a": {"command": "x"}}}).first().command == "x"
    assert servers(spark, "{oops").count() == 0
    assert servers(spark, [1]).count() == 0
    assert servers(spark, {"mcp": {"a": {}}}, "x/readme.md").count() == 0
    assert servers(spark, {"mcp": {"a": {}}}, "x/any.json").first().line == 3


def test_server_rules(spark):
    assert findings(spark) == {"010": ("INFO", "No command/url/type specified")}
    assert findings(spark, type="stdio") == {}
    assert findings(spark, url="http://h/x") == {"001": ("MEDIUM", "Remote endpoint: http://h/x"), "002": ("HIGH", "Plain HTTP endpoint: http://h/x")}
    assert findings(spark, url="https://h/fetch/run.sh").keys() == {"001", "009"}
    assert findings(spark, command="python", args=["-c", "print(1)"]) == {}
    assert findings(spark, command="bash", args=["run.sh"]) == {}
    assert findings(spark, command="/bin/sh", args=["-c", "ls"]) == {"003": ("MEDIUM", "Shell command line: /bin/sh -c ls")}
    assert findings(spark, command="node x; y") == {"003": ("MEDIUM", "Shell command line: node x; y")}
    assert findings(spark, command="npx", args=["-y", "left-pad"]) == {"004": ("HIGH", "Dynamic runner: npx; bare unpinned package(s): left-pad")}
    assert findings(spark, command="npx", args=["-y", "@scope/pkg", "left-pad@1.2"]) == {"004": ("MEDIUM", "Dynamic runner: npx")}
    assert findings(spark, command="npm", args=["run", "start", "server.js"]) == {"004": ("MEDIUM", "Dynamic runner: npm")}
    assert findings(spark, command="x", env={"API_KEY": "1", "LANG": "de"}) == {"005": ("LOW", "Environment variables: API_KEY, LANG"), "006": ("HIGH", "Secret-like env var: API_KEY")}
    assert findings(spark, command="x", args=["/", "/etc/", "../up", "/tmp/p", "."]) == {
        "007": ("MEDIUM", "Broad path in args: filesystem root (/); system-level directory (/etc); parent-directory escape; filesystem root (.)")
    }
    assert findings(spark, command="uvx", args=["pkg==1.0", "/var"])["007"][0] == "HIGH"
    assert findings(spark, command="x", args=["--force", 8080]) == {"008": ("HIGH", "Suspicious args: --force 8080")}
    long = findings(spark, command="sh", args=["-c", "a" * 300])["003"][1]
    assert long == "Shell command line: sh -c " + "a" * 300
    shown = sr.server_findings(servers(spark, {"mcpServers": {"one": {"command": "sh", "args": ["-c", "a" * 300]}}}), shown=160).first().evidence
    assert len(shown) == len("Shell command line: ") + 160 and shown.endswith("...")
