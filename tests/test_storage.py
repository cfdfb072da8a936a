from folioflow import storage


def test_native_memory_is_given_back(spark, monkeypatch):
    """Every table written hands back what the driver's JVM has freed; Java 17.0.9 and later say how much."""
    said, give = [], storage.give_back
    monkeypatch.setattr(storage, "give_back", lambda s: said.append(give(s)))
    assert storage.durable(spark.range(5)).count() == 5
    assert len(said) == 1
    assert said[0] is None or said[0].startswith("Trim native heap")


def test_a_jvm_that_cannot_trim(spark, monkeypatch):
    from py4j.protocol import Py4JError

    def closed(*_):
        raise Py4JError("no such command")

    monkeypatch.setattr(spark.sparkContext._gateway, "new_array", closed)
    assert storage.give_back(spark) is None
