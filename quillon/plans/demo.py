"""Three small demo tables for an engine that has none."""

from __future__ import annotations

from . import printer
from .engine import Engine

# The names in the demo rows.
PEOPLE = ["Ana", "Beto", "Caro", "Dora", "Elin", "Fabio", "Gina", "Hugo", "Iris", "Juan", "Kira", "Leo", "Mia", "Nico", "Olga", "Pablo", "Rosa", "Saul", "Tina", "Ugo", "Vera", "Wes", "Xime", "Yago"]
CITIES = ["Lima", "Cusco", "Arequipa", "Trujillo", "Piura"]
CATEGORIES = ["A", "B", "C"]
GOODS = ["Teclado", "Mouse", "Monitor", "Laptop", "Cable", "Webcam", "Router", "SSD", "RAM", "GPU"]

TABLES = """
CREATE TABLE clientes (id INT PRIMARY KEY, nombre VARCHAR, ciudad VARCHAR, edad INT) USING HASH;
CREATE TABLE ventas (id INT PRIMARY KEY, cliente_id INT, monto INT, categoria VARCHAR) USING BPLUS;
CREATE TABLE productos (id INT PRIMARY KEY, nombre VARCHAR, precio FLOAT, stock INT) USING BPLUS_CLUSTERED
"""


def rows() -> dict[str, list[list]]:
    # The numbers in the demo rows.
    return {
        "clientes": [[n, name, CITIES[(n - 1) % 5], 18 + n * 7 % 43] for n, name in enumerate(PEOPLE, 1)],
        "ventas": [[n, 1 + n * 5 % 24, 100 + n * 137 % 900, CATEGORIES[n % 3]] for n in range(1, 41)],
        "productos": [[n, GOODS[n % 10], float(50 + n * 37 % 950), n * 13 % 200] for n in (1 + i * 7 % 30 for i in range(30))],
    }


def seed(engine: Engine) -> bool:
    """Create and fill the demo tables, unless the engine has tables; tells whether it did."""
    if engine.tables:
        return False
    fill = [{"kind": "insert", "table": table, "columns": None, "rows": r} for table, r in rows().items()]
    for result in engine.sql(f"{TABLES.strip()};\n{printer.program(fill)}"):
        if result.error:
            raise ValueError(result.error)
    return True
