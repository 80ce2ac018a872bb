from quillon.plans import demo
from quillon.plans.engine import Engine


def test_demo_tables(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    assert demo.seed(e) and not demo.seed(e)
    assert [e.query(f"SELECT id FROM {t}").count() for t in ("clientes", "ventas", "productos")] == [24, 40, 30]
    assert [tuple(r) for r in e.query("SELECT * FROM clientes WHERE id = 7").collect()] == [(7, "Gina", "Cusco", 24)]
    assert [tuple(r) for r in e.query("SELECT * FROM ventas WHERE id = 40").collect()] == [(40, 9, 180, "B")]
    assert [tuple(r) for r in e.query("SELECT * FROM productos WHERE id = 30").collect()] == [(30, "Teclado", 210.0, 190)]
    sold = {r[0]: r[1] for r in e.query("SELECT categoria, COUNT(*) FROM ventas GROUP BY categoria").collect()}
    assert sold == {"A": 13, "B": 14, "C": 13}
    assert e.query("SELECT ventas.id FROM ventas JOIN clientes ON ventas.cliente_id = clientes.id").count() == 40
