"""Classification by ordered rules: layers, frameworks, languages, ignored files.

FIXED VALUES: the lists below are names that code and paths really have; their
order is their priority.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Layer, parts of the class name, marks in the content.
SPRING = (
    ("Controller", ("controller",), ("@controller", "@restcontroller")),
    ("Service", ("service",), ("@service",)),
    ("Repository", ("repository", "dao"), ("@repository",)),
    ("Entity", ("entity", "model"), ("@entity",)),
    ("Config", ("config", "configuration"), ("@configuration",)),
    ("Test", ("test",), ("@test",)),
    ("Util", ("util", "helper"), ()),
)
#: Layer, parts of the lower-case path, stems, stem prefixes, stem suffixes.
PYTHON_PATHS = (
    ("Entity", ("models.py",), ("models",), (), ()),
    ("View", ("views.py",), ("views",), (), ()),
    ("Serializer", ("serializers.py",), ("serializers",), (), ()),
    ("Form", ("forms.py",), ("forms",), (), ()),
    ("Admin", ("admin.py",), ("admin",), (), ()),
    ("Router", ("urls.py",), ("urls",), (), ()),
    ("Middleware", ("middleware",), (), (), ()),
    ("Signal", ("signals.py",), ("signals",), (), ()),
    ("Task", ("tasks.py",), ("tasks",), (), ()),
    ("Command", ("/management/commands/",), (), (), ()),
    ("Migration", ("/migrations/",), (), (), ()),
    ("Controller", ("routes.py", "endpoints.py"), (), (), ()),
    ("Schema", ("schemas.py",), ("schemas",), (), ()),
    ("Config", ("config", "settings"), (), (), ()),
    ("Test", ("test",), (), ("test_",), ()),
    ("Util", ("utils", "helpers"), (), (), ()),
    ("Service", ("services",), (), (), ("_service",)),
    ("Repository", ("repository", "repositories"), (), (), ()),
)
#: Layers by base class of a framework, lower case.
CLASS_BASES = {
    "django": (("Entity", ("models.model", "model")), ("Serializer", ("serializer", "modelserializer")), ("View", ("viewset", "apiview", "genericapiview")), ("Form", ("form", "modelform")), ("Admin", ("modeladmin", "admin"))),
    "flask": (("Controller", ("resource", "methodview")),),
    "fastapi": (("Schema", ("basemodel",)),),
}
CLASS_NAMES = (("Test", ("test",)), ("Service", ("service",)), ("Repository", ("repository", "dao")), ("Config", ("config", "settings")), ("Util", ("util", "helper")))
#: Layers by decorator of a framework.
FUNCTION_DECORATORS = {
    "django": (("View", ("api_view", "action")), ("Signal", ("receiver",)), ("Task", ("task", "shared_task"))),
    "flask": (("Controller", ("route", "get", "post", "put", "delete")),),
    "fastapi": (("Controller", ("get", "post", "put", "delete", "patch", "api_route")),),
}
FRAMEWORK_IMPORTS = {
    "django": ("django", "rest_framework", "django.db", "django.views", "django.contrib", "django.http", "django.forms", "django.admin"),
    "flask": ("flask", "flask_restful", "flask_login", "flask_sqlalchemy"),
    "fastapi": ("fastapi", "pydantic", "starlette"),
}
#: Layer by base class, and by decorator, of a framework.
DETECTOR_BASES = {
    "django": {
        "models.Model": "Entity",
        "Model": "Entity",
        "View": "View",
        "TemplateView": "View",
        "ListView": "View",
        "DetailView": "View",
        "CreateView": "View",
        "UpdateView": "View",
        "DeleteView": "View",
        "FormView": "View",
        "APIView": "View",
        "ViewSet": "View",
        "ModelViewSet": "View",
        "GenericViewSet": "View",
        "ReadOnlyModelViewSet": "View",
        "GenericAPIView": "View",
        "Serializer": "Serializer",
        "ModelSerializer": "Serializer",
        "HyperlinkedModelSerializer": "Serializer",
        "Form": "Form",
        "ModelForm": "Form",
        "ModelAdmin": "Admin",
        "TabularInline": "Admin",
        "StackedInline": "Admin",
        "MiddlewareMixin": "Middleware",
    },
    "flask": {
        "Resource": "Controller",
        "MethodView": "Controller",
        "FlaskForm": "Form",
        "db.Model": "Entity",
    },
    "fastapi": {
        "BaseModel": "Schema",
        "BaseSettings": "Config",
    },
}
DETECTOR_DECORATORS = {
    "django": {
        "api_view": "View",
        "action": "View",
        "permission_classes": "View",
        "authentication_classes": "View",
        "login_required": "View",
        "permission_required": "View",
        "csrf_exempt": "View",
        "require_http_methods": "View",
        "require_GET": "View",
        "require_POST": "View",
        "receiver": "Signal",
        "admin.register": "Admin",
        "register": "Admin",
        "shared_task": "Task",
        "task": "Task",
    },
    "flask": {
        "route": "Controller",
        "get": "Controller",
        "post": "Controller",
        "put": "Controller",
        "delete": "Controller",
        "patch": "Controller",
        "errorhandler": "Controller",
        "before_request": "Middleware",
        "after_request": "Middleware",
        "before_first_request": "Middleware",
        "login_required": "View",
    },
    "fastapi": {
        "get": "Controller",
        "post": "Controller",
        "put": "Controller",
        "delete": "Controller",
        "patch": "Controller",
        "options": "Controller",
        "head": "Controller",
        "api_route": "Controller",
        "websocket": "Controller",
        "on_event": "Middleware",
        "middleware": "Middleware",
        "Depends": "Service",
    },
}
DETECTOR_NAMES = (("service", "Service"), ("repository", "Repository"), ("dao", "Repository"), ("controller", "Controller"), ("view", "View"), ("serializer", "Serializer"), ("form", "Form"), ("model", "Entity"), ("schema", "Schema"), ("middleware", "Middleware"), ("admin", "Admin"), ("config", "Config"), ("settings", "Config"), ("test", "Test"), ("util", "Util"), ("helper", "Util"))
DETECTOR_FILES = (("models.py", "Entity"), ("views.py", "View"), ("serializers.py", "Serializer"), ("forms.py", "Form"), ("admin.py", "Admin"), ("urls.py", "Router"), ("signals.py", "Signal"), ("tasks.py", "Task"), ("middleware.py", "Middleware"), ("management/commands", "Command"), ("migrations", "Migration"), ("tests.py", "Test"), ("test_", "Test"))
DETECTOR_FOLDERS = (("services", "Service"), ("repositories", "Repository"), ("controllers", "Controller"), ("routes", "Router"), ("endpoints", "Controller"), ("schemas", "Schema"), ("utils", "Util"), ("helpers", "Util"), ("config", "Config"), ("settings", "Config"), ("tests", "Test"))
#: Suffix -> language; the order breaks ties for the primary language.
LANGUAGE_SUFFIXES = ((".java", "java"), (".py", "python"), (".pyw", "python"), (".kt", "kotlin"), (".kts", "kotlin"), (".html", "html"), (".htm", "html"), (".xml", "xml"), (".yaml", "yaml"), (".yml", "yaml"), (".properties", "properties"))
IGNORED_FOLDERS = ("target", "build", ".git", "node_modules", ".idea", ".vscode", "venv", ".venv", "env", ".env", "virtualenv", ".virtualenv", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", "dist", "eggs", ".eggs", "site-packages", ".ipynb_checkpoints", "htmlcov")
IGNORED_SUFFIXES = (".class", ".jar", ".war", ".log", ".pyc", ".pyo", ".pyd", ".so", ".dll", ".dylib", ".exe", ".zip", ".tar", ".gz", ".rar", ".jpg", ".jpeg", ".png", ".gif", ".ico", ".svg", ".pdf", ".doc", ".docx", ".xls", ".xlsx", "lib/python", ".coverage")
PROJECT_MARKS = {"django": ("manage.py", "settings.py", "wsgi.py", "asgi.py"), "flask": ("app.py", "application.py"), "fastapi": ("main.py",)}
PYTHON_MARKS = ("setup.py", "pyproject.toml", "setup.cfg", "requirements.txt", "Pipfile", "poetry.lock", "manage.py", "app.py", "main.py")
FRAMEWORK_INFO = (
    ("django", "Django", "High-level Python web framework", ["Model", "View", "Serializer", "Form", "Admin", "Signal", "Task"], ["models.py", "views.py", "serializers.py", "forms.py", "admin.py"]),
    ("flask", "Flask", "Lightweight WSGI web application framework", ["Controller", "Model", "Form", "Service"], ["app.py", "routes.py", "models.py"]),
    ("fastapi", "FastAPI", "Modern, fast web framework for building APIs", ["Controller", "Schema", "Service", "Repository"], ["main.py", "routers/", "schemas.py", "models.py"]),
    ("unknown", "Unknown", "Framework not detected", [], []),
)


def first_of(rules: list[tuple[Column, str]], otherwise: Column | str = "Unknown") -> Column:
    """The value of the first condition that holds."""
    last = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return reduce(lambda rest, rule: F.when(rule[0], rule[1]).otherwise(rest), reversed(rules), last)


def either(conditions: list[Column]) -> Column:
    """Whether one of the conditions holds."""
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def holds(text: Column, parts) -> Column:
    """Whether a text contains one of the parts."""
    return either([text.contains(p) for p in parts])


def spring_layer(name: Column, content: Column) -> Column:
    """Layer of a Java class from its name and content."""
    n, c = F.lower(name), F.lower(content)
    return first_of([(holds(n, names) | holds(c, marks), layer) for layer, names, marks in SPRING])


def file_name(path: Column) -> Column:
    """Last component, lower case."""
    return F.lower(F.regexp_extract(F.translate(path, "\\", "/"), "([^/]*)$", 1))


def python_path_layer(path: Column) -> Column:
    """Layer of a Python file from its path."""
    low, stem = F.lower(F.translate(path, "\\", "/")), F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")
    return first_of([(holds(low, parts) | (stem.isin(*stems) if stems else F.lit(False)) | either([stem.startswith(p) for p in starts]) | either([stem.endswith(s) for s in ends]), layer) for layer, parts, stems, starts, ends in PYTHON_PATHS])


def python_class_layer(name: Column, bases: Column, decorators: Column, framework: Column, file_layer: Column) -> Column:
    """Layer of a Python class: framework base classes, then its name, then the file's layer."""
    low, lower = F.lower(name), F.transform(bases, lambda b: F.lower(b))
    rules = [((framework == f) & F.arrays_overlap(lower, F.array(*map(F.lit, names))), layer) for f, table in CLASS_BASES.items() for layer, names in table]
    rules.append(((framework == "django") & low.contains("middleware"), "Middleware"))
    rules.append((F.exists(decorators, lambda d: F.lower(d).contains("test")), "Test"))
    return first_of(rules + [(holds(low, parts), layer) for layer, parts in CLASS_NAMES], file_layer)


def python_function_layer(decorators: Column, framework: Column, parent: Column) -> Column:
    """Layer of a function from its decorators (whole or last component), else the parent's."""
    names = F.flatten(F.transform(decorators, lambda d: F.array(F.lower(d), F.lower(F.element_at(F.split(d, r"\."), -1)))))
    return first_of([((framework == f) & F.arrays_overlap(names, F.array(*map(F.lit, wanted))), layer) for f, table in FUNCTION_DECORATORS.items() for layer, wanted in table], parent)


def framework_from_imports(modules: Column) -> Column:
    """django, flask, fastapi or null from top-level modules."""
    has = lambda *m: F.arrays_overlap(modules, F.array(*map(F.lit, m)))
    return F.when(has("django", "rest_framework"), "django").when(has("flask"), "flask").when(has("fastapi"), "fastapi")


def framework_score(modules: Column) -> Column:
    """Struct of framework and confidence: the share of a framework's modules that are imported, doubled, at most 1."""
    share = {f: F.size(F.array_intersect(modules, F.array(*map(F.lit, m)))) / len(m) for f, m in FRAMEWORK_IMPORTS.items()}
    top = F.greatest(*share.values())
    name = F.when(top == 0, "unknown").when(share["django"] == top, "django").when(share["flask"] == top, "flask").otherwise("fastapi")
    return F.struct(name.alias("framework"), F.round(F.least(top * 2, F.lit(1.0)), 6).alias("confidence"))


def _first_known(values: Column, framework: Column, tables: dict) -> Column:
    """The layer of the first value (whole or last component) that a framework's table has."""
    flat = [(f, x, layer) for f, table in tables.items() for x, layer in table.items()]
    known = F.create_map(*[F.lit(v) for f, x, layer in flat for v in (f"{f}:{x}", layer)])
    of = lambda d: F.coalesce(known[F.concat(framework, F.lit(":"), d)], known[F.concat(framework, F.lit(":"), F.element_at(F.split(d, r"\."), -1))])
    return F.get(F.array_compact(F.transform(values, of)), F.lit(0))


def detected_layer(path: Column, framework: Column, class_name: Column | None = None, bases: Column | None = None, function_name: Column | None = None, decorators: Column | None = None) -> Column:
    """Layer by class, else function, else path; and where it came from. Struct of layer and indicator."""
    decorators = F.array().cast("array<string>") if decorators is None else decorators
    options = []
    if class_name is not None:
        named = first_of([(F.lower(class_name).contains(p), layer) for p, layer in DETECTOR_NAMES], F.lit(None).cast("string"))
        options.append((F.coalesce(_first_known(bases, framework, DETECTOR_BASES), _first_known(decorators, framework, DETECTOR_DECORATORS), named), "class"))
    if function_name is not None:
        options.append((F.coalesce(_first_known(decorators, framework, DETECTOR_DECORATORS), F.when(F.lower(function_name).startswith("test"), "Test")), "function"))
    low = F.lower(F.translate(path, "\\", "/"))
    files = first_of([(low.contains(p) | file_name(path).startswith(p), layer) for p, layer in DETECTOR_FILES] + [(low.contains(f"/{p}/") | low.endswith(f"/{p}"), layer) for p, layer in DETECTOR_FOLDERS], F.lit(None).cast("string"))
    options.append((files, "path"))
    layer = F.coalesce(*[c for c, _ in options], F.lit("Unknown"))
    indicator = reduce(lambda rest, o: F.when(o[0].isNotNull(), F.lit(o[1])).otherwise(rest), reversed(options), F.lit(None).cast("string"))
    return F.struct(layer.alias("layer"), indicator.alias("indicator"))


def detection(path: Column, imports: Column, class_name: Column | None = None, bases: Column | None = None, function_name: Column | None = None, decorators: Column | None = None) -> Column:
    """Struct of framework (by imports, else unknown), layer, and all indicators that speak for them."""
    framework = F.coalesce(framework_from_imports(imports), F.lit("unknown"))
    found = detected_layer(path, framework, class_name, bases, function_name, decorators)
    said = F.array(F.when(framework != "unknown", F.concat(F.lit("imports suggest "), framework)), F.when(found["indicator"].isNotNull(), F.concat(found["indicator"], F.lit(" pattern suggests "), found["layer"])))
    return F.struct(framework.alias("framework"), found["layer"].alias("layer"), F.array_compact(said).alias("indicators"))


def language_of(path: Column) -> Column:
    """Language by suffix."""
    low = F.lower(path)
    return first_of([(low.endswith(s), name) for s, name in LANGUAGE_SUFFIXES], "unknown")


def ignored(path: Column, folders=IGNORED_FOLDERS, suffixes=IGNORED_SUFFIXES) -> Column:
    """Whether a path has an ignored folder as a component or an ignored suffix."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    return F.arrays_overlap(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, folders))) | F.exists(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.endswith(".egg-info")) | either([path.endswith(s) for s in suffixes])


def primary_language(paths: DataFrame, path: str = "path") -> DataFrame:
    """One row: the language of most source files; ties by the order of suffixes, java if there is none."""
    order = {name: n for n, (_, name) in reversed(list(enumerate(LANGUAGE_SUFFIXES)))}
    counted = paths.select(language_of(F.col(path)).alias("language")).where(F.col("language").isin("java", "python", "kotlin", "html")).groupBy("language").agg(F.count(F.lit(1)).alias("n"))
    rank = first_of([(F.col("language") == name, F.lit(n)) for name, n in order.items()], F.lit(99))
    return counted.agg(F.coalesce(F.max_by("language", F.struct("n", -rank)), F.lit("java")).alias("language"))


def project_type(paths: DataFrame, path: str = "path") -> DataFrame:
    """One row of flags: python, java, kotlin, web."""
    name, low = F.regexp_extract(path, "([^/]*)$", 1), F.lower(path)
    flag = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return paths.agg(flag(name.isin(*PYTHON_MARKS, "__init__.py")).alias("python"), flag(name.isin("pom.xml", "build.gradle")).alias("java"), flag(low.endswith(".kt")).alias("kotlin"), flag(low.endswith(".html") | (name == "package.json")).alias("web"))


def framework_of_project(files: DataFrame) -> DataFrame:
    """One row from path and text: a point for each kind of marker file, two for each mention in requirements."""
    name, low = F.regexp_extract("path", "([^/]*)$", 1), F.lower("text")
    needs = name.rlike(r"^requirements.*\.txt$") | (name == "pyproject.toml")
    one = lambda c: F.max(F.when(c, 1).otherwise(0))
    marks = {"django": sum((one(name == m) for m in PROJECT_MARKS["django"]), F.lit(0)), "flask": one(name.isin(*PROJECT_MARKS["flask"])), "fastapi": one(name == "main.py")}
    points = files.agg(*[(marks[f] + 2 * F.sum(F.when(needs & low.contains(f), 1).otherwise(0))).alias(f) for f in marks])
    top = F.greatest("django", "flask", "fastapi")
    return points.select("django", "flask", "fastapi", F.when(F.coalesce(top, F.lit(0)) == 0, "unknown").when(F.col("django") == top, "django").when(F.col("flask") == top, "flask").otherwise("fastapi").alias("framework"))


def framework_table(spark) -> DataFrame:
    """Facts about the frameworks."""
    return spark.createDataFrame(list(FRAMEWORK_INFO), "framework string, name string, description string, typical_layers array<string>, file_patterns array<string>")


def import_category(modules: DataFrame, paths_column: str = "file_path") -> DataFrame:
    """``modules`` (module, file_path) with stdlib, local or third_party."""
    import sys

    table = modules.sparkSession.createDataFrame([(m,) for m in sorted(sys.stdlib_module_names)], "std string")
    joined = modules.join(F.broadcast(table), F.element_at(F.split("module", r"\."), 1) == F.col("std"), "left")
    local = F.array_contains(F.split(paths_column, "/"), F.element_at(F.split("module", r"\."), 1))
    return joined.withColumn("category", F.when(F.col("std").isNotNull(), "stdlib").when(local, "local").otherwise("third_party")).drop("std")
