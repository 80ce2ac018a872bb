"""Persons and their photos, kept in tables of an engine."""

from __future__ import annotations

from quillon.operators.identify import Remembered

from .engine import Engine, SemanticError


class Persons:
    """Persons and their photos in two managed tables of an engine.

    Ids go on from the largest. A change that fails half way is taken back.
    """

    def __init__(self, engine: Engine, size: int, persons: str = "persons", photos: str = "photos", memory: Remembered | None = None):
        self.engine, self.persons, self.photos, self.memory = engine, persons, photos, memory
        if persons not in engine.tables:
            self._do(f"CREATE TABLE {persons} (id INT PRIMARY KEY, name VARCHAR(80), origin VARCHAR(20))")
            self._do(f"CREATE TABLE {photos} (id INT PRIMARY KEY, person_id INT, file VARCHAR(200), emb VECTOR({size}))")

    def _do(self, text: str) -> None:
        wrong = next((r.error for r in self.engine.sql(text) if r.error), None)
        if wrong:
            raise SemanticError(wrong)

    def _next(self, table: str) -> int:
        return (self.engine.query(f"SELECT MAX(id) FROM {table}").first()[0] or 0) + 1

    def _own(self, person: int) -> None:
        if self.engine.query(f"SELECT id FROM {self.persons} WHERE id = {int(person)} AND origin = 'own'").isEmpty():
            raise SemanticError(f"there is no person {person}")

    def _insert_photos(self, person: int, photos: dict[str, list[float]]) -> list[int]:
        first = self._next(self.photos)
        ids = list(range(first, first + len(photos)))
        rows = [[i, person, file, {"vector": [float(x) for x in v]}] for i, (file, v) in zip(ids, photos.items(), strict=True)]
        done = self.engine.run({"kind": "insert", "table": self.photos, "columns": None, "rows": rows})
        if done.error:
            raise SemanticError(done.error)
        return ids

    def register(self, name: str, photos: dict[str, list[float]]) -> int:
        """A new person with photos (file to vector); the name must be new among one's own."""
        name = " ".join(name.split())
        if not name or not photos:
            raise SemanticError("a person takes a name and photos")
        quoted = name.replace("'", "''")
        if not self.engine.query(f"SELECT id FROM {self.persons} WHERE name = '{quoted}' AND origin = 'own'").isEmpty():
            raise SemanticError(f"there is a person {name} already")
        person = self._next(self.persons)
        self._do(f"INSERT INTO {self.persons} VALUES ({person}, '{quoted}', 'own')")
        try:
            self._insert_photos(person, photos)
        except SemanticError:
            self._do(f"DELETE FROM {self.persons} WHERE id = {person}")
            raise
        return person

    def add_photos(self, person: int, photos: dict[str, list[float]]) -> list[int]:
        self._own(person)
        ids = self._insert_photos(person, photos)
        if self.memory:
            self.memory.forget(person)
        return ids

    def remove(self, person: int) -> None:
        self._own(person)
        self._do(f"BEGIN TRANSACTION; DELETE FROM {self.photos} WHERE person_id = {int(person)}; DELETE FROM {self.persons} WHERE id = {int(person)}; END TRANSACTION")
        if self.memory:
            self.memory.forget(person)
