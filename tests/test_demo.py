from pyspark.sql import functions as F

from sigloom.operators.autoencoder import split_demo
from sigloom.sources import demo


def test_demo_records_and_files(spark, tmp_path):
    config = demo.DemoConfig(2, 1, 2, 1.5, 200.0)
    meta = demo.write_demo(spark, str(tmp_path), config)
    assert meta.count() == 5 and meta.where("is_anomalous").count() == 2
    back = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "records"))
    assert back.count() == 5 * 300 and set(back.columns) == {"time", "voltage", "record"}
    again = demo.demo_samples(spark, config)
    assert again.agg(F.sum("voltage")).first() == demo.demo_samples(spark, config).agg(F.sum("voltage")).first()
    train, test = split_demo(meta)
    assert train.count() == 2 and test.count() == 3
