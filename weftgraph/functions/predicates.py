"""Predicates over nodes as Column expressions, and the fixed lists that they test against."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of paths (each must match in full).
TEST_PATH = (
    r"(?:.*[/\\][A-Za-z0-9.]*[Tt]ests?[/\\].*|.*[/\\]__tests__[/\\].*|.*[/\\]test-[A-Za-z0-9_-]+[/\\].*"
    r"|.*\.(?:test|spec)\.[jt]sx?$|.*_test\.[a-z]+$|.*[/\\]src[/\\]test[/\\].*)"
)
VENDORED_PATH = (
    r"(?:.*[/\\]node_modules[/\\].*|.*[/\\]vendor[/\\].*|.*[/\\]third_party[/\\].*|.*[/\\]\.gradle[/\\].*|.*[/\\]bower_components[/\\].*"
    r"|.*[/\\]static[/\\](?:js|lib|libs)[/\\].*|.*\.min\.[jt]sx?$|.*\.bundle\.[jt]sx?$|.*\.chunk\.[jt]sx?$"
    r"|.*[/\\](?:angular|vue|react|jquery|bootstrap|lodash|moment|axios)(?:-[\d.]+)?(?:\.min)?\.js$)"
)

# Names of methods that frameworks call.
FRAMEWORK_METHODS = (
    "__init__", "constructor", "Up", "Down", "BuildTargetModel", "BuildModel", "OnModelCreating", "CreateDbContext", "main", "Main", "Dispose", "DisposeAsync", "Close",
    "Finalize", "OnNavigatedTo", "OnInitialized", "OnInitializedAsync", "ConfigureWebHost", "CreateHostBuilder", "CreateWebHostBuilder", "doGet", "doPost", "doPut", "doDelete",
    "doHead", "doOptions", "doTrace", "service", "init", "destroy", "contextInitialized", "contextDestroyed", "sessionCreated", "sessionDestroyed", "afterPropertiesSet",
    "onApplicationEvent", "OnGet", "OnPost", "OnPut", "OnDelete", "OnGetAsync", "OnPostAsync", "OnPutAsync", "OnDeleteAsync", "OnConnectedAsync", "OnDisconnectedAsync",
    "StartAsync", "StopAsync", "ExecuteAsync", "Invoke", "InvokeAsync",
)
# Attributes of methods, of classes, and of entity classes (Java in lower case, C# as written).
FRAMEWORK_ATTRIBUTES = (
    "command", "tool", "callback", "bean", "postconstruct", "predestroy", "eventlistener", "scheduled", "requestmapping", "getmapping", "postmapping", "putmapping",
    "deletemapping", "patchmapping", "beforeeach", "aftereach", "beforeall", "afterall", "postload", "prepersist", "postpersist", "preupdate", "postupdate", "preremove",
    "postremove", "override", "ApiController", "HttpGet", "HttpPost", "HttpPut", "HttpDelete", "HttpPatch", "TestMethod", "DataTestMethod", "Fact", "Theory", "SetUp", "TearDown",
    "OneTimeSetUp", "OneTimeTearDown", "Authorize", "AllowAnonymous", "GlobalSetup", "GlobalCleanup", "Route", "NonAction", "ServiceFilter", "TypeFilter", "TestInitialize",
    "TestCleanup", "ClassInitialize", "ClassCleanup", "AssemblyInitialize", "AssemblyCleanup", "Benchmark", "kafkalistener", "rabbitlistener", "jmslistener", "path", "get",
    "post", "put", "delete", "patch", "produces", "consumes", "jsoncreator", "jsonvalue", "jsongetter", "jsonsetter", "jsonproperty", "exceptionhandler", "initbinder",
    "modelattribute", "async", "transactional",
)
FRAMEWORK_CLASS_ATTRIBUTES = (
    "component", "service", "repository", "controller", "restcontroller", "configuration", "springbootapplication", "stateless", "stateful", "singleton", "messagedriven",
    "webservlet", "webfilter", "weblistener", "ApiController", "TestClass", "TestFixture",
)
ENTITY_ATTRIBUTES = ("entity", "data", "embeddable", "mappedsuperclass", "getter", "setter")
HTTP_VERB_ATTRIBUTES = ("HttpGet", "HttpPost", "HttpPut", "HttpDelete", "HttpPatch")
CONFIGURE_METHODS = ("configure", "Configure", "ConfigureServices")
CONFIGURE_ENDINGS = ("Configuration", "Configurer", "Adapter", "Options")
CONFIGURE_CLASSES = ("Startup", "Program")


def full_match(c: Column, pattern: str) -> Column:
    """A regular expression that must cover the whole string; null for null."""
    return c.rlike(f"^(?:{pattern})$")


def wrapped(pattern: str) -> str:
    """A user's pattern made to match anywhere."""
    if not pattern:
        return pattern
    return ("" if pattern.startswith(".*") else ".*") + pattern + ("" if pattern.endswith(".*") else ".*")


def in_subdirectory(c: Column, subdirectory: str) -> Column:
    """Bounded by path segments; the text of ``subdirectory`` is a pattern as it stands."""
    return full_match(c, f".*/{subdirectory}/.*|.*/{subdirectory}$")


def is_test(path: Column) -> Column:
    return full_match(path, TEST_PATH)


def is_vendored(path: Column) -> Column:
    return full_match(path, VENDORED_PATH)


def has_attribute(attributes: Column, names: Iterable[str]) -> Column:
    """Whether the JSON text of a list holds one of the names as an element, by a search for the quoted name."""
    text = F.coalesce(attributes, F.lit("[]"))
    return text.rlike('"(?:' + "|".join(re.escape(x) for x in names) + ')"')


def mentions(attributes: Column, names: Iterable[str]) -> Column:
    """Whether the text holds one of the names anywhere; null for null."""
    return attributes.rlike("|".join(re.escape(x) for x in names))


def decoded(attributes: Column) -> Column:
    """The list in a JSON text; empty for null and for what is no list."""
    return F.coalesce(F.from_json(attributes, "array<string>"), F.array().cast("array<string>"))


def simple_name(full_name: Column) -> Column:
    return F.substring_index(full_name, ".", -1)


def short_ref(full_name: Column) -> Column:
    """'Type.member' without parameters."""
    return F.substring_index(F.regexp_replace(full_name, r"\(.*$", ""), ".", -2)


def bare_type(name: Column) -> Column:
    """A type's simple name without generics and parameters."""
    return simple_name(F.regexp_replace(name, r"[<(].*$", ""))


def relative(path: Column, root: Column) -> Column:
    """``path`` below ``root``; as it is if it does not lie there."""
    base = F.regexp_replace(root, "/+$", "")
    return F.when(F.startswith(path, F.concat(base, F.lit("/"))), F.substr(path, F.length(base) + 2)).otherwise(path)
