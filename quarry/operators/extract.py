"""Events out of commands and messages, as Columns: the rules are regular, so nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Operations of a version-control command, in the order they are looked for.
GIT_OPERATIONS = (("checkout", "branch"), ("commit", "commit"), ("merge", "merge"), ("rebase", "rebase"), ("stash", "stash"), ("push", "push"), ("pull", "pull"), ("log", "log"), ("diff", "diff"), ("status", "status"), ("branch", "branch"), ("reset", "reset"), ("add", "add"), ("cherry-pick", "cherry-pick"), ("tag", "tag"), ("fetch", "fetch"), ("clone", "clone"), ("worktree", "worktree"))
# Commands that change the environment.
ENVIRONMENT = r"\bsource\s+\S*activate\b|\bexport\s+\w+=|\bnvm\s+use\b|\bpyenv\s+(?:shell|local|global)\b|\bconda\s+activate\b|\brbenv\s+(?:shell|local|global)\b|\bnpm\s+(?:install|ci)\b|\bpip\s+install\b|\bbun\s+install\b|\b(?:yarn|pnpm)\s+(?:add|install)\b|\bcargo\s+(?:install|add)\b|\bgo\s+(?:install|get)\b|\b(?:rustup|asdf|volta)\b|\bdeno\s+install\b"
# Classes of errors with what their text has, first match wins.
ERRORS = (
    ("file_not_found", r"enoent|no such file|cannot find module|filenotfounderror"),
    ("command_not_found", r"command not found|: not found|\bexit(?:\s+code)?\s*[:=]?\s*127\b"),
    ("edit_match_failed", r"old_string not found|string to replace not found"),
    ("git_conflict", r"^conflict|merge conflict|conflict.*(?:merge|rebase|git)|(?:merge|rebase|git).*conflict"),
    ("timeout", r"etimedout|timed out|timeout|deadline exceeded"),
    ("permission_denied", r"eacces|permission denied|operation not permitted|eperm"),
    ("syntax_error", r"syntaxerror|\berror\s+ts\d{3,5}\b|unexpected token|unexpected end of|parse error"),
    ("test_failed", r"tests? failed|\bfail(?:ed)?\b.*\btest\b|\b\d+\s+tests?\s+failed\b|assertion|(?:^|\n)fail\s"),
    ("runtime_error", r"typeerror|referenceerror|rangeerror|uncaught exception|traceback \(most recent call last\)|nullpointerexception"),
)
_JS = ("npm", "pnpm", "yarn", "bun")
_QUESTION, _CLAUSE = r"[?？؟¿]", r"[,;，；、،]"


def working_directory(command: str) -> Column:
    """The directory a command changes to, unquoted; empty if none."""
    hit = F.regexp_extract(command, r"\bcd\s+(?:\"([^\"]+)\"|'([^']+)'|(\S+))", 0)
    return F.regexp_replace(F.regexp_replace(hit, r"^cd\s+", ""), r"^[\"']|[\"']$", "")


def git_operation(command: str) -> Column:
    """The operation of a git command, flags between allowed; null if none."""
    parsed = F.regexp_extract(command, r"\bgit(?:\s+-\S+(?:\s+[^\s-]\S*)?)*?\s+([a-z][a-z-]*)\b", 1)
    known = F.coalesce(*[F.when(parsed == verb, op) for verb, op in GIT_OPERATIONS])
    loose = F.coalesce(known, *[F.when(F.rlike(command, F.lit(rf"\bgit\s+{verb}\b")), op) for verb, op in GIT_OPERATIONS])
    return F.when(F.contains(command, F.lit("git")), loose)


def commit_message(command: str) -> Column:
    """The message given to a commit on the command line; empty if none."""
    hit = F.regexp_extract(F.when(F.contains(command, F.lit("commit")), F.col(command)).otherwise(""), r"\bgit\b.*\bcommit\b.*?\s(?:-[a-z]*m|--message)(?:\s+|=)(\"[^\"]*\"|'[^']*'|\S+)", 1)
    return F.regexp_replace(hit, r"^[\"']|[\"']$", "")


def environment_command(command: str) -> Column:
    """The command with exported values masked if it changes the environment, else null."""
    return F.when(F.rlike(command, F.lit(ENVIRONMENT)), F.regexp_replace(command, r"\bexport\s+(\w+)=\S*", "export $1=***"))


def error_class(message: str) -> Column:
    low = F.lower(message)
    return F.coalesce(*[F.when(F.rlike(low, F.lit("(?s)" + pattern)), name) for name, pattern in ERRORS], F.lit("unknown"))


def command_tool(command: str) -> Column:
    """The first word after assignments and wrappers, lower case."""
    return F.regexp_extract(F.lower(F.trim(command)), r"^(?:\w+=\S*\s+)*(?:(?:sudo|time|nice)\s+)*(\S*)", 1)


def command_class(command: str) -> Column:
    tool, low = command_tool(command), F.lower(command)

    def says(pattern: str) -> Column:
        return F.rlike(low, F.lit(rf"\b(?:{pattern})\b"))

    js = tool.isin(*_JS)
    return (
        F.when(tool == "git", "git")
        .when((js | tool.isin("pip", "pip3")) & says("install|add|ci"), "install").when((tool == "brew") & says("install"), "install")
        .when(tool.isin("vitest", "jest", "pytest", "mocha", "playwright", "cypress") | (js & says("test")), "test")
        .when(tool.isin("eslint", "tslint", "ruff", "flake8", "pylint") | (js & says("lint")), "lint")
        .when(tool.isin("prettier", "black", "gofmt", "rustfmt") | (js & says("format|fmt")), "format")
        .when(tool.isin("tsc", "webpack", "rollup", "vite", "esbuild", "make") | ((js | tool.isin("cargo", "go")) & says("build")), "build")
        .when((js & says("run")) | tool.isin("node", "python", "python3", "deno"), "run")
        .otherwise("other")
    )


def duration_bucket(ms: Column) -> Column:
    ms = F.coalesce(ms, F.lit(0))
    return F.when(ms < 1_000, "fast").when(ms < 10_000, "medium").when(ms < 60_000, "slow").otherwise("timeout")


def looks_like_decision(message: str) -> Column:
    t = F.trim(message)
    return F.rlike(t, F.lit(_CLAUSE)) & F.rlike(t, F.lit(r"\p{L}")) & ~F.rlike(t, F.lit(_QUESTION)) & F.length(t).between(15, 500)


def intent(message: str) -> Column:
    """investigate for a question, implement for a short imperative, else null."""
    t = F.trim(message)
    return F.when(F.rlike(t, F.lit(_QUESTION)), "investigate").when((F.length(t) > 0) & (F.length(t) < 60) & F.rlike(t, F.lit(r"\p{L}")), "implement")


def message_features(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Letters, words, capitals' share, files, questions, fences, URLs and distinct words of each message."""
    t = F.col(text)
    letters = F.length(F.regexp_replace(t, r"\P{L}+", ""))
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    return docs.where(F.col(key).isNotNull() & t.isNotNull()).select(
        F.col(key).alias("key"), letters.cast("long").alias("letters"), F.size(words).cast("long").alias("words"), F.when(letters > 0, F.round(F.length(F.regexp_replace(t, r"\P{Lu}+", "")) / letters, 6)).otherwise(0.0).alias("upper"),
        F.regexp_count(t, F.lit(r"[\w-]+\.(?:py|ts|js|go|rs|md|json|yaml|sh|sql)\b")).cast("long").alias("files"), F.regexp_count(t, F.lit(_QUESTION)).cast("long").alias("questions"),
        F.floor(F.regexp_count(t, F.lit("```")) / 2).alias("fences"), F.regexp_count(t, F.lit(r"https?://")).cast("long").alias("urls"), F.size(F.array_distinct(F.transform(words, lambda w: F.lower(w)))).cast("long").alias("distinct_words"),
    )


def references(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, host, n: hosts of the URLs in each text, this machine's left out."""
    url = F.explode(F.regexp_extract_all(F.col(text), F.lit(r"https?://([^\s/?#)\]>\"']+)"), F.lit(1)))
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), url.alias("host")).withColumn("host", F.lower("host"))
    return rows.where("not host rlike '^(localhost|127[.]0[.]0[.]1)'").groupBy("key", "host").agg(F.count("*").alias("n"))


# --- tool calls -----------------------------------------------------------------------------------------------------
# What a call of a tool is recorded as.
TOOL_TYPES = (
    ("read", "file_read"), ("write", "file_write"), ("edit", "file_edit"), ("notebookedit", "file_edit"), ("glob", "file_glob"), ("grep", "file_search"), ("taskupdate", "task_update"), ("taskcreate", "task_create"), ("todowrite", "task"),
    ("enterplanmode", "plan_enter"), ("exitplanmode", "plan_exit"), ("skill", "skill"), ("agent", "subagent"), ("task", "subagent"), ("enterworktree", "worktree"), ("askuserquestion", "decision_question"), ("webfetch", "webfetch"),
)
# Names of files with rules, keys whose values are masked, longest text of a call's arguments in bytes.
RULE_FILES = r"(?i)(?:^|[/\\])(?:CLAUDE|AGENTS|GEMINI|QWEN)\.md$|(?:^|[/\\])\.cursorrules$|[/\\]memory[/\\][^/\\]+\.md$"
MASKED_KEYS = r"authorization|api[_-]?key|access[_-]?key|private[_-]?key|token|secret|password|passwd|credential|cookie|bearer"
ARGUMENT_BYTES = 2048


def call_of(data: str = "data") -> tuple[Column, Column, Column]:
    """(tool, path, arguments) of a call stored as JSON; nulls where it is none."""
    j = F.try_parse_json(F.when(F.startswith(F.ltrim(data), F.lit("{")), F.col(data)))
    text = lambda path: F.try_variant_get(j, path, "string")
    return text("$.tool"), F.coalesce(text("$.input.file_path"), text("$.args.path"), text("$.input.path")), F.coalesce(text("$.input"), text("$.args"))


def tool_event(tool: Column, path: Column) -> Column:
    """The type that a call is recorded as: rule for a read of a file with rules, mcp for names of servers, else by the tool; null if none."""
    low = F.lower(tool)
    return F.when((low == "read") & F.rlike(path, F.lit(RULE_FILES)), "rule").when(F.startswith(low, F.lit("mcp__")), "mcp").otherwise(F.coalesce(*[F.when(low == t, k) for t, k in TOOL_TYPES]))


def server_and_tool(tool: Column) -> tuple[Column, Column]:
    """Server and tool of a name such as mcp__server__tool; empty if it is no such name."""
    return F.regexp_extract(tool, r"^mcp__(.+?)__(.+)$", 1), F.regexp_extract(tool, r"^mcp__(.+?)__(.+)$", 2)


def patch_targets(patch: str) -> Column:
    """(path, type) of each file that a patch adds, updates, deletes or moves to, each once, in order."""
    heads = F.regexp_extract_all(F.col(patch), F.lit(r"(?m)^\*\*\* ((?:Add File|Update File|Delete File|Move to): [^\r\n]+)"), F.lit(1))
    pairs = F.transform(heads, lambda h: F.struct(F.trim(F.regexp_replace(h, r"^[^:]+: ", "")).alias("path"), F.when(F.startswith(h, F.lit("Add")), "file_write").otherwise("file_edit").alias("type")))
    return F.array_distinct(F.filter(pairs, lambda p: p["path"] != ""))


def is_tool_error(response: str, own_prefix: str = "quarry:") -> Column:
    """Whether a shell's response tells of an error; the log's own messages don't."""
    own = F.startswith(F.col(response), F.lit(own_prefix)) | F.rlike(response, F.lit(rf"^echo [\"']{own_prefix}"))
    return ~own & F.rlike(response, F.lit(r"(?i)exit code [1-9]|error:|fail"))


def inferred_exit(text: str) -> Column:
    """The exit code that a text names, else 127 for a command not found, 1 for a line of error, 0."""
    named = F.regexp_extract(text, r"(?i)\bexit[ _]code[ :]+(\d{1,3})", 1)
    return F.when(named != "", named.cast("int")).when(F.rlike(F.lower(text), F.lit(r"command not found|: not found")), 127).when(F.rlike(text, F.lit(r"(?im)^\s*(?:error|fatal)\b")), 1).otherwise(0)


def hard_failure(language: Column, code: Column, stdout: Column) -> Column:
    """Whether a call failed: a shell's exit 1 with output is soft (a search without a hit)."""
    return (code != 0) & ~((language == "shell") & (code == 1) & (F.length(F.trim(stdout)) > 0))


def masked_arguments(data: str) -> Column:
    """JSON text with the values of secret keys masked, whatever their depth, cut to ARGUMENT_BYTES characters."""
    masked = F.regexp_replace(data, rf"(?i)([\"'][^\"']*(?:{MASKED_KEYS})[^\"']*[\"']\s*:\s*)(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|[^\s,}}\]]+)", '$1"[REDACTED]"')
    return F.substring(masked, 1, ARGUMENT_BYTES)


def kib_named(text: str) -> Column:
    """Bytes of a size such as (12.5 KB) in a text; 0 if it names none."""
    return F.coalesce(F.floor(F.regexp_extract(text, r"\((\d{1,9}(?:\.\d{1,3})?) ?KB\)", 1).try_cast("double") * 1024 + 0.5), F.lit(0)).cast("long")


def metadata_pairs(data: str) -> Column:
    """`name:value` pairs of the flat members of JSON data, in the order of their names; null if it is no object."""
    m = F.from_json(F.when(F.startswith(F.ltrim(data), F.lit("{")), F.col(data)), "map<string,string>", {"mode": "PERMISSIVE"})
    flat = F.filter(F.array_sort(F.map_entries(m)), lambda e: e["value"].isNotNull() & ~F.startswith(e["value"], F.lit("{")) & ~F.startswith(e["value"], F.lit("[")))
    return F.array_join(F.transform(flat, lambda e: F.concat(e["key"], F.lit(":"), e["value"])), " ")


def second_duration_bucket(ms: Column) -> Column:
    """The buckets of the second classifier: borders at 1, 5 and 30 seconds."""
    return F.when(ms < 1_000, "fast").when(ms < 5_000, "medium").when(ms < 30_000, "slow").otherwise("timeout")


# Scripts in the order in which ties go.
SCRIPTS = (("latin", "Latin"), ("cyrillic", "Cyrillic"), ("han", "Han"), ("hiragana", "Hiragana"), ("katakana", "Katakana"), ("hangul", "Hangul"), ("arabic", "Arabic"), ("hebrew", "Hebrew"), ("devanagari", "Devanagari"), ("thai", "Thai"), ("greek", "Greek"))


def dominant_script(text: str) -> Column:
    """The script most letters of a text have; none without letters of the known scripts."""
    counts = F.array(*[F.struct(F.length(F.regexp_replace(text, rf"\P{{Is{p}}}+", "")).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("s")) for i, (name, p) in enumerate(SCRIPTS)])
    best = F.array_max(counts)
    return F.when(best["n"] > 0, best["s"]).otherwise("none")


# --- attribution ----------------------------------------------------------------------------------------------------
def attribution(events: DataFrame, origins: DataFrame) -> DataFrame:
    """id, project, source, confidence: the project of each record by what it says and where its session began.

    origins: session_id, origin (one each). A path signal is the data of a change of directory, or of a file record that looks like a
    path; relative ones hang below the origin. Inside the origin it counts as the session's (0.82); else a change of directory is its
    own project (0.9) and a file belongs to its folder (0.7). Without a signal the origin stands with 0.35, else nothing.
    """
    slash = lambda c: F.regexp_replace(F.regexp_replace(c, r"\\", "/"), "(?<=.)/+$", "")
    rows = events.join(origins, "session_id", "left").withColumn("o", slash(F.coalesce("origin", F.lit(""))))
    like_path = F.rlike("data", F.lit(r"^[/~.]?[\w./\\@+-]*[/\\][\w./\\@+-]+$")) & ~F.contains("data", F.lit("*"))
    signal = F.when((F.col("type") == "cwd") & like_path | F.col("type").isin("file_read", "file_write", "file_edit", "file_glob", "rule") & like_path, slash(F.col("data")))
    absolute = F.when(F.startswith(signal, F.lit("/")), signal).when(F.col("o") != "", F.concat("o", F.lit("/"), F.regexp_replace(signal, r"^\./", "")))
    rows = rows.withColumn("p", absolute)
    inside = (F.col("o") != "") & ((F.col("p") == F.col("o")) | F.startswith("p", F.concat("o", F.lit("/"))))
    folder = F.when(F.col("type").isin("file_read", "file_write", "file_edit", "rule"), F.regexp_replace("p", r"/[^/]*$", "")).otherwise(F.col("p"))
    has = F.col("p").isNotNull()
    return rows.select(
        "id", F.when(has & inside, F.col("o")).when(has & (F.col("type") == "cwd"), F.col("p")).when(has, folder).otherwise(F.col("o")).alias("project"),
        F.when(has & inside, "session_origin").when(has & (F.col("type") == "cwd"), "cwd_event").when(has, "event_path").when(F.col("o") != "", "session_origin").otherwise("unknown").alias("source"),
        F.when(has & inside, 0.82).when(has & (F.col("type") == "cwd"), 0.9).when(has, 0.7).when(F.col("o") != "", 0.35).otherwise(0.0).alias("confidence"),
    )


# --- formats --------------------------------------------------------------------------------------------------------
def one_decimal(x: Column) -> Column:
    """With one decimal, halves up."""
    return F.format_string("%.1f", F.floor(x * 10 + 0.5) / 10)


def format_bytes(n: Column) -> Column:
    return F.when(n < 1024, F.format_string("%d B", n.cast("long"))).when(n < 1024 * 1024, F.concat(one_decimal(n / 1024), F.lit(" KB"))).otherwise(F.concat(one_decimal(n / 1048576), F.lit(" MB")))


def format_minutes(m: Column) -> Column:
    """Whole minutes as `45m` or `2h 5m`."""
    m = F.floor(m).cast("long")
    return F.when(m < 60, F.format_string("%dm", m)).otherwise(F.format_string("%dh %dm", F.floor(m / 60).cast("long"), m % 60))


def format_count(n: Column) -> Column:
    """`950`, `1.2K`, `3.4M`."""
    return F.when(n < 1000, n.cast("long").cast("string")).when(n < 1_000_000, F.concat(one_decimal(n / 1000), F.lit("K"))).otherwise(F.concat(one_decimal(n / 1_000_000), F.lit("M")))


# --- messages -------------------------------------------------------------------------------------------------------
# How messages of a kind begin or what they have.
ROLE_STARTS = r"(?i)^(?:you are|act as|behave as|take the role of|as an? \w+,|always|never|from now on)\b"
BLOCKER_MARKS = r"(?i)\b(?:blocked|stuck|can'?t proceed|does ?n[o']t work|not working|fails?|failing|error:|exception)\b"
SOLVED_MARKS = r"[✓✔✅]|(?i)\b(?:works now|fixed|solved|resolved)\b"


def message_kinds(message: str) -> Column:
    """The kinds of a message, in this order: plan, decision, role, investigate or implement, goal, blocker or blocker_resolved, data (over 1,024 characters)."""
    t = F.trim(message)
    n = F.length(t)
    solved = F.rlike(t, F.lit(SOLVED_MARKS))
    kinds = [
        (F.rlike(t, F.lit(r"^/plan\b")), F.lit("plan")), (looks_like_decision(message), F.lit("decision")), (F.rlike(t, F.lit(ROLE_STARTS)) & n.between(8, 120), F.lit("role")), (intent(message).isNotNull(), intent(message)),
        (F.rlike(t, F.lit(r"(?i)^goal\s*:")), F.lit("goal")), (solved, F.lit("blocker_resolved")), (~solved & F.rlike(t, F.lit(BLOCKER_MARKS)), F.lit("blocker")), (n > 1024, F.lit("data")),
    ]
    return F.filter(F.array(*[F.when(has, kind) for has, kind in kinds]), lambda k: k.isNotNull())


def numbered_references(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, ref: distinct numbers behind a `#` that no letter, digit or `_` precedes."""
    refs = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"(?<!\w)#(\d{1,9})(?!\w)"), F.lit(1)))
    return docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.explode(refs).alias("ref"))
