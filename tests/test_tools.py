from rankweave.__main__ import main


def test_tools_end_to_end(spark, tmp_path):
    at = lambda x: f"{tmp_path}/{x}"
    main(["generate", at("g"), "--size1", "40", "--size2", "30", "--nnz", "600", "--nnz-test", "60", "--rank", "3"], spark)
    main(["factorize", at("g/train.parquet"), at("g/w"), at("g/h"), at("f"), "--method", "als", "--loss", "Nzsl_L2(0.01)", "--epochs", "4", "--test", at("g/test.parquet")], spark)
    loss = [r.loss for r in spark.read.parquet(at("f/trace")).orderBy("epoch").collect()]
    assert len(loss) == 5 and loss[-1] < loss[0] and spark.read.parquet(at("f/w")).count() == 40
    main(["convert", at("g/train.parquet"), at("m.mmc")], spark)
    main(["center", at("m.mmc"), at("c.csv"), "--test", at("g/test.parquet"), "--test-out", at("t.csv")], spark)
    assert abs(spark.read.schema("i long, j long, x double").csv(at("c.csv")).agg({"x": "avg"}).first()[0]) < 1e-9
    main(["apply", at("m.mmc"), "x * 2", at("d.parquet")], spark)
    main(["project", at("m.mmc"), at("p"), "--threshold", "14", "--repeat"], spark)
    main(["sample", at("m.mmc"), at("s"), "--size", "12"], spark)
    main(["block", at("m.mmc"), at("b"), "--blocks1", "2", "--blocks2", "3"], spark)
    main(["factors", at("i"), "--size1", "40", "--size2", "30", "--rank", "3"], spark)
    assert spark.read.parquet(at("s/map1")).count() == 12 and spark.read.parquet(at("b/blocks")).count() == 600 and spark.read.parquet(at("i/h")).count() == 30
