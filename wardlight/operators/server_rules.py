"""Tool-server configurations: JSON documents to server rows, and what is wrong with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions import text as tx
from wardlight.operators import rule_catalog as rc
from wardlight.sources.corpus import base_name

STRINGS = "array<string>"


def is_config(path: Column) -> Column:
    name = base_name(path)
    return name.isin(rc.SERVER_FILES) | (F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)) == "json")


def read_servers(docs: DataFrame) -> DataFrame:
    """(document columns, server, command, args, env, url, type, transport, line).

    The server map is the first of the known keys that holds an object. Every
    level is parsed to raw JSON text first, so one odd value spoils nothing.
    ``line`` is the first line that contains the server name.
    """
    kept = [c for c in docs.columns if c != "text"]
    keys = ", ".join(f"{k} string" for k in rc.SERVER_KEYS)
    top = F.from_json(F.col("text"), keys)
    maps = F.coalesce(*[F.when(F.ltrim(F.col(f"_top.{k}")).startswith("{"), F.col(f"_top.{k}")) for k in rc.SERVER_KEYS])

    def placed(entry: Column) -> Column:
        has_name = F.transform(F.col("_lines"), lambda line: line.contains(entry["key"]))
        return F.struct(entry["key"].alias("server"), entry["value"].alias("_cfg"), F.array_position(has_name, True).cast("int").alias("_at"))

    rows = (
        docs.where(is_config(F.col("path")))
        .withColumn("_top", top)
        .withColumn("_map", F.from_json(maps, "map<string,string>"))
        .withColumn("_lines", tx.split_lines(F.col("text")))  # once a document, not once a server
        .select(*kept, F.explode(F.transform(F.map_entries("_map"), placed)).alias("e"))
        .select(*kept, "e.*")
        .where(F.ltrim("_cfg").startswith("{"))
        .withColumn("c", F.from_json("_cfg", "command string, args string, env string, url string, type string, transport string"))
    )
    at = F.col("_at")
    return rows.select(
        *kept, "server", "c.command",
        F.when(F.ltrim("c.args").startswith("["), F.from_json("c.args", STRINGS)).alias("args"),
        F.when(F.ltrim("c.env").startswith("{"), F.from_json("c.env", "map<string,string>")).alias("env"),
        "c.url", "c.type", "c.transport",
        F.when(at > 0, at).alias("line"),
    )


def _command() -> Column:
    return F.coalesce(tx.strip(F.col("command")), F.lit(""))


def _joined(args: Column) -> Column:
    return F.array_join(args, " ")


def _args() -> Column:
    return F.coalesce("args", F.array().cast(STRINGS))


def _shown(text: Column, shown: int | None) -> Column:
    return text if shown is None else F.when(F.length(text) > shown, F.concat(F.left(text, F.lit(shown - 3)), F.lit("..."))).otherwise(text)


def shell_line(shown: int | None = None) -> Column:
    """The command line when a shell hides what it runs, else null; whole unless a caller bounds it."""
    cmd, args = _command(), _args()
    line = F.when(F.size(args) > 0, F.concat_ws(" ", cmd, _joined(args))).otherwise(cmd)
    meta = rc.SHELL_METACHAR
    inline = F.exists(args, lambda a: a.isin(rc.SHELL_INLINE_FLAGS) | a.startswith("--command="))
    wrapped = cmd.rlike(meta) | (tx.has(cmd, rc.SHELL_BINARY, fold=True) & (inline | line.rlike(meta)))
    return F.when((cmd != "") & wrapped, _shown(line, shown))


def _is_runner() -> Column:
    return tx.has(_command(), rc.DYNAMIC_RUNNER, fold=True)


def bare_packages() -> Column:
    """Unpinned registry names among the positional arguments of a runner."""
    args = _args()
    verb = F.lower(F.get(args, F.lit(0)))
    skip = F.when(verb.isin(rc.SCRIPT_VERBS), 2).when(verb.isin(rc.RUNNER_VERBS), 1).otherwise(0)
    rest = F.slice(args, skip + 1, F.greatest(F.size(args) - skip, F.lit(0)))

    def bare(a: Column) -> Column:
        start = F.lit(False)
        for s in ("@", "-", "/", ".", "C:", "C\\"):
            start = start | a.startswith(s)
        return ~start & ~a.rlike(rc.VERSION_PIN) & ~tx.has(a, rc.LOCAL_FILE, fold=True) & a.rlike(rc.BARE_PACKAGE)

    return F.filter(rest, bare)


def broad_paths() -> Column:
    """Why arguments grant a root, a system folder or a way out of the folder."""
    def reason(a: Column) -> Column:
        norm = F.rtrim(a, F.lit("/\\"))
        return (
            F.when(a.isin(rc.FS_ROOTS), F.concat(F.lit("filesystem root ("), a, F.lit(")")))
            .when(norm.isin(rc.FS_SYSTEM_DIRS), F.concat(F.lit("system-level directory ("), norm, F.lit(")")))
            .when(F.array_contains(F.split(F.replace(a, F.lit("\\"), F.lit("/")), "/"), ".."), F.lit("parent-directory escape"))
        )

    return F.array_compact(F.transform(_args(), reason))


def server_findings(servers: DataFrame, shown: int | None = None) -> DataFrame:
    """One row per finding; a server yields several, a secret variable one each.

    Evidence holds whole command lines; ``shown`` bounds them for display.
    """
    kept = [c for c in servers.columns if c not in ("server", "command", "args", "env", "url", "type", "transport")]
    url, env = F.coalesce("url", F.lit("")), F.coalesce("env", F.create_map().cast("map<string,string>"))
    names = F.array_sort(F.map_keys(env))
    joined = _joined(_args())

    def finding(rule: str, evidence: Column, severity: Column | None = None, words: Column | None = None) -> Column:
        fixed, title = rc.SERVER_RULES[rule]
        said = F.concat(F.lit("MCP server '"), "server", F.lit("': "), F.lit(title) if words is None else words)
        return F.struct(
            F.lit(rule).alias("rule_id"), (F.lit(fixed) if severity is None else severity).alias("severity"),
            F.lit(title).alias("title"), said.alias("description"), evidence.alias("evidence"),
        )

    stages = (
        servers.withColumn("_shell", shell_line(shown))
        .withColumn("_bare", bare_packages())
        .withColumn("_broad", broad_paths())
        .withColumn("_runner", _is_runner())
    )
    bare, broad, shell = F.col("_bare"), F.col("_broad"), F.col("_shell")
    runner = F.concat(F.lit("Dynamic runner: "), "command")
    single = F.array_compact(F.array(
        F.when(url != "", finding("AS-MCP-001", F.concat(F.lit("Remote endpoint: "), url))),
        F.when(url.startswith("http://"), finding("AS-MCP-002", F.concat(F.lit("Plain HTTP endpoint: "), url))),
        F.when(shell.isNotNull(), finding("AS-MCP-003", F.concat(F.lit("Shell command line: "), shell))),
        F.when(F.col("_runner"), finding(
            "AS-MCP-004",
            F.when(F.size(bare) > 0, F.concat(runner, F.lit("; bare unpinned package(s): "), F.array_join(bare, ", "))).otherwise(runner),
            F.when(F.size(bare) > 0, F.lit("HIGH")).otherwise(F.lit("MEDIUM")),
        )),
        F.when(F.size(names) > 0, finding("AS-MCP-005", F.concat(F.lit("Environment variables: "), F.array_join(names, ", ")))),
    ))
    secrets = F.transform(
        F.filter(F.map_keys(env), lambda v: tx.has(v, rc.SECRET_ENV_NAME, fold=True)),
        lambda v: finding("AS-MCP-006", F.concat(F.lit("Secret-like env var: "), v), words=F.concat(F.lit("receives '"), v, F.lit("'"))),
    )
    nothing = (_command() == "") & (url == "") & (F.coalesce("type", F.lit("")) == "") & (F.coalesce("transport", F.lit("")) == "")
    more = F.array_compact(F.array(
        F.when(F.size(broad) > 0, finding(
            "AS-MCP-007", F.concat(F.lit("Broad path in args: "), F.array_join(broad, "; ")),
            F.when(F.col("_runner"), F.lit("HIGH")).otherwise(F.lit("MEDIUM")),
        )),
        F.when(tx.has(joined, rc.SUSPICIOUS_ARGS, fold=True), finding("AS-MCP-008", F.concat(F.lit("Suspicious args: "), _shown(joined, shown)))),
        F.when(tx.has(url, rc.REMOTE_EXEC, fold=True), finding("AS-MCP-009", F.concat(F.lit("Remote executable URL: "), url))),
        F.when(nothing, finding("AS-MCP-010", F.lit("No command/url/type specified"))),
    ))
    return stages.select(*kept, "server", F.inline(F.concat(single, secrets, more))).withColumn("matched_text", F.col("evidence"))


