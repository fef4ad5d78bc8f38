"""Path-based architecture class of a file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftgraph.functions import paths

# Fixed values the results depend on: file names, then folders in this order.
FILE_NAMES = {
    "models.py": "Model",
    "views.py": "Controller",
    "urls.py": "Route",
    "admin.py": "Admin",
    "serializers.py": "Serializer",
    "forms.py": "Form",
    "settings.py": "Config",
    "apps.py": "Config",
    "tests.py": "Test",
    "conftest.py": "Test",
    "manage.py": "Config",
}
FOLDERS = (
    ("components", "Component"),
    ("controllers", "Controller"),
    ("services", "Service"),
    ("serializers", "Serializer"),
    ("migrations", "Migration"),
    ("management", "Command"),
    ("admin", "Admin"),
    ("models", "Model"),
    ("middleware", "Middleware"),
    ("routes", "Route"),
    ("hooks", "Hook"),
    ("pages", "Page"),
    ("views", "Page"),
    ("config", "Config"),
    ("utils", "Util"),
    ("lib", "Util"),
    ("tests", "Test"),
    ("__tests__", "Test"),
)


def is_test(path: Column) -> Column:
    lower = F.lower(path)
    name = paths.basename(lower)
    return (
        lower.rlike(r"(^|/)(tests|__tests__)/")
        | name.contains(".test.") | name.contains(".spec.")
        | (name.endswith(".py") & (name.startswith("test_") | name.endswith("_test.py")))
    )


def category(path: Column) -> Column:
    """Test rule, then exact file name, then the first listed folder on the path."""
    segments = F.split(F.lower(path), "/")
    name = paths.basename(F.lower(path))
    out = F.when(is_test(path), "Test")
    for file_name, label in FILE_NAMES.items():
        out = out.when(name == file_name, label)
    for folder, label in FOLDERS:
        out = out.when(F.array_contains(segments, folder), label)
    return out.otherwise("Unknown")
