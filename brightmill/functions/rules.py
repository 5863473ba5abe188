"""Rule tables. All are small and fixed, and every operator takes them as parameters, so they can be extended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DETECTORS = "shell_exec network file_access secrets dynamic_exec autonomy".split()

#: capability: (risk, explanation, impact)
CAPABILITIES = {
    "EXECUTE": ("high", "Can start shell commands or interpreter code on the machine.", "Injected instructions could damage or take over the host."),
    "SEND": ("high", "Can pass data to other systems over a network.", "Local data could end up at endpoints nobody trusts."),
    "READ": ("medium", "Can read files of the local disk.", "Private files could reach later steps or leave the machine."),
    "WRITE": ("high", "Can create, change, move or delete files.", "Project files could be altered or lost."),
    "SECRETS": ("high", "Touches credentials or places that hold them.", "Credentials could be disclosed and misused."),
    "DYNAMIC": ("high", "Runs code or loads modules chosen at run time.", "Untrusted input could turn into running code."),
    "AUTONOMY": ("medium", "Can keep acting or schedule actions without a user.", "Risky behaviour could repeat in the background."),
}
LEVELS = "info low medium high".split()
OTHER_CAPABILITY = ("medium", "Has a capability that may be sensitive.", "Misuse could widen what an injected prompt can reach.")


def _pairs(text: str) -> list[tuple[str, str]]:
    return [(module, name) for part in text.split(";") for module, _, names in [part.strip().partition(":")] for name in names.split()]


#: (module prefix, attribute suffix) in order; the first that fits names the finding.
NETWORK_CALLS = _pairs(
    "requests:get post put delete patch head Session; httpx:get post put delete patch head Client AsyncClient; urllib:request;"
    "urllib.request:urlopen; urllib3:PoolManager; socket:socket; aiohttp:ClientSession; websockets:connect; websocket:create_connection"
)
CLIENTS = [f"{m}.{n}" for m, n in _pairs("aiohttp:ClientSession; httpx:AsyncClient Client; requests:Session session")]
CLIENT_VERBS = "delete get head options patch post put request send".split()
URL_VERBS = [*CLIENT_VERBS, *"fetch mount open urlopen".split()]
SOCKET_ENDS = "connect create_connection socket".split()
LOCAL_DATABASES = "aiosqlite duckdb sqlite3".split()
HTTP_SETTINGS = "AsyncHTTPTransport ClientTimeout Cookies HTTPTransport Headers Request Response Subprotocol Timeout".split()

WRITE_MODES = "a ab w wb x".split()
SHUTIL_WRITES = "copy copy2 copyfile move".split()
OS_WRITES = "remove rename replace unlink".split()

DYNAMIC_NAMES = "__import__ compile eval exec".split()
DYNAMIC_CALLS = [f"{m}.{n}" for m, n in _pairs("builtins:eval exec; importlib:import_module; runpy:run_module run_path")]

AUTONOMY_CALLS = [f"{m}.{n}" for m, n in _pairs("apscheduler.schedulers.background:BackgroundScheduler; asyncio:create_task; multiprocessing:Process; sched:scheduler; schedule:every; threading:Thread Timer")]
AUTONOMY_METHODS = "add_job enter enterabs start".split()

#: Own design: calls and subscripts that read credentials. (dotted name, confidence)
SECRET_CALLS = [
    ("os.getenv", 0.9), ("os.environ.get", 0.9), ("keyring.get_password", 0.95), ("keyring.get_credential", 0.95), ("getpass.getpass", 0.85),
    ("dotenv.load_dotenv", 0.85), ("dotenv.dotenv_values", 0.85), ("hvac.Client", 0.9), ("google.cloud.secretmanager.SecretManagerServiceClient", 0.95),
    ("azure.keyvault.secrets.SecretClient", 0.95),
]
SECRET_METHODS = [("get_secret_value", 0.85), ("access_secret_version", 0.9), ("read_secret_version", 0.85)]

#: decorator key: framework where imports tell nothing
DECORATORS = dict(
    x.split("=") for x in "ai_model=marvin call_tool=mcp fn=marvin function_tool=openai_agents kernel_function=semantic_kernel list_tools=mcp register_for_llm=autogen register_tool=metagpt tool=langchain_or_crewai tool_plain=pydantic_ai".split()
)
BASE_CLASSES = dict(x.split("=") for x in "BaseTool=langchain_or_crewai StructuredTool=langchain Toolkit=agno".split())
#: (call, receiver, module prefixes, shape, function keyword, list keyword, name keyword, framework)
FACTORIES = [
    ("from_defaults", "FunctionTool", ["llama_index"], "single", "fn", None, "name", "llamaindex"),
    ("from_defaults", "QueryEngineTool", ["llama_index"], "single", None, None, "name", "llamaindex"),
    ("Tool", None, ["dspy"], "single", None, None, "name", "dspy"),
    ("Agent", None, ["swarm"], "list", None, "functions", None, "openai_swarm"),
    ("Agent", None, ["google.adk", "google_adk"], "list", None, "tools", None, "google_adk"),
    ("FunctionTool", None, ["camel"], "single", None, None, None, "camel"),
]
#: framework: module prefixes
FRAMEWORKS = [
    (prefix, name)
    for name, prefixes in (x.split("=") for x in (
        "langchain=langchain_core,langchain crewai=crewai pydantic_ai=pydantic_ai mcp=mcp,fastmcp openai_agents=openai_agents,agents semantic_kernel=semantic_kernel "
        "autogen=autogen_core,autogen strands=strands,strands_tools haystack=haystack agno=agno,phi,phidata metagpt=metagpt marvin=marvin agency_swarm=agency_swarm "
        "smolagents=smolagents google_adk=google.adk,google_adk llamaindex=llama_index dspy=dspy camel=camel openai_swarm=swarm"
    ).split())
    for prefix in prefixes.split(",")
]
MCP_NAMES = "app fastmcp mcp server".split()
UNKNOWN_FRAMEWORK = "unknown"

#: (risk id, title, why, capabilities needed, whether a destructive write is needed too), in report order
RISKS = [
    ("data_exfiltration", "Data Exfiltration Risk", "Files can be changed or read and data can leave over the network.", ["SEND", "WRITE"], False),
    ("remote_control", "Remote Control Risk", "Commands can run and the network can be reached.", ["EXECUTE", "SEND"], False),
    ("secret_leak", "Secret Leakage Risk", "Local files can be read and their contents sent away.", ["READ", "SEND"], False),
    ("destructive_agent", "Destructive Agent Risk", "Commands can run and files can be destroyed.", ["EXECUTE", "WRITE"], True),
]
DESTRUCTIVE = "delete remove rename replace unlink".split()

LANGUAGES = dict(
    x.split("=") for x in "c=C cc=C++ clj=Clojure cpp=C++ cs=C# cxx=C++ dart=Dart erl=Erlang ex=Elixir exs=Elixir go=Go hs=Haskell java=Java jl=Julia kt=Kotlin kts=Kotlin lua=Lua php=PHP pl=Perl r=R rb=Ruby rs=Rust scala=Scala sh=Shell swift=Swift zig=Zig".split()
)

_COMMON = "__pycache__ venv .venv site-packages .github .git".split()
_TESTS = "benchmarks benchmark tests test".split()
SCAN_SKIPS = [*_COMMON, *_TESTS]
PACKAGE_SKIPS = "doc docs scripts .dist-info".split()
ENTRY_SKIPS = [*_COMMON, *_TESTS, "node_modules"]
LANGUAGE_SKIPS = [*_COMMON, *"target vendor third-party third_party out dist coverage build node_modules .nuxt .next".split()]
TS_SKIPS = [*_COMMON, *_TESTS, *"out dist coverage build node_modules .svelte-kit .nuxt .next".split()]
TS_SUFFIXES = "cjs cts js mjs mts ts".split()

REPORT_NOTE = "Findings come from patterns in the code; they prove neither behaviour at run time nor exploitability."


def table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A rule table as a DataFrame."""
    return spark.createDataFrame([tuple(r) for r in rows], schema)
