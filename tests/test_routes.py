from dispatchlens.operators.routes import efficient_routes


def test_efficient_routes_reads_its_input_once(spark):
    rows = [("0_1", 10.0 + i, 2.0, 3.0 + i) for i in range(5)] + [("1_1", 20.0, 4.0, -1.0), ("1_1", None, 5.0, None), (None, 9.0, 9.0, 9.0)]
    facts = spark.createDataFrame(rows, "Route_Type string, Time_taken_min double, Distance_km double, Profit double")
    read = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            read.add(len(frame))
            yield frame

    out = {r.Route_Type: r for r in efficient_routes(facts.mapInPandas(counted, facts.schema)).collect()}
    assert read.value == len(rows)
    assert set(out) == {"0_1", "1_1"}
    assert (out["0_1"].time_mean, out["0_1"].time_median, out["0_1"].time_count, out["0_1"].profit_mean) == (12.0, 12.0, 5, 5.0)
    assert (out["1_1"].time_mean, out["1_1"].time_median, out["1_1"].time_count, out["1_1"].distance_mean) == (20.0, 20.0, 1, 4.5)
