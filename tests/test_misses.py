"""Rows without a partner raise instead of vanishing."""

import pytest

from fringelake.operators import antennas, recombine, visibility


def test_unknown_antenna(spark):
    ants = spark.createDataFrame([(0, 0.0, 0.0, 0.0)], "ant long, x double, y double, z double")
    samples = spark.createDataFrame([(0, 1)], "antenna1 long, antenna2 long")
    with pytest.raises(Exception, match="unknown antenna"):
        antennas.attach_baselines(samples, ants).collect()


def test_combined_sets_must_match(vis_frame):
    def frame(chans, freq=1e8):
        n = len(chans)
        return vis_frame(antenna1=[0] * n, antenna2=[1] * n, time=[0.0] * n, chan=chans, pol=[0] * n,
                         freq=[freq] * n, re=[1.0] * n, im=[0.0] * n, weight=[1.0] * n)

    key = ["antenna1", "antenna2", "time", "chan", "pol"]
    assert visibility.combine(frame([0, 1]), frame([0, 1], 1e8 + 0.5), key=key).count() == 2
    with pytest.raises(Exception, match="missing"):
        visibility.combine(frame([0, 1]), frame([0]), key=key).collect()
    with pytest.raises(Exception, match="frequency"):
        visibility.combine(frame([0]), frame([0], 2e8), key=key).collect()


def test_appended_channels_need_equal_rows(spark):
    schema = ("antenna1 long, antenna2 long, time double, uvw array<double>, "
              "frequency array<double>, vis array<double>, weight array<double>")
    row = lambda t: (0, 1, t, [0.0], [1.0], [1.0], [1.0])
    left = spark.createDataFrame([row(0.0), row(1.0)], schema)
    assert visibility.concatenate_frequencies(left, left).count() == 2
    with pytest.raises(Exception, match="missing in the other"):
        visibility.concatenate_frequencies(left, left.where("time = 0")).collect()


def test_source_off_the_image(spark):
    sources = spark.createDataFrame([(0, 0, 1.0), (9, 0, 1.0)], "y long, x long, flux double")
    with pytest.raises(Exception, match="off the image"):
        recombine.source_image(sources, 8).collect()
    table = [1.0, 2.0] * 4
    assert recombine.source_image(sources.where("y = 0"), 8, table).first()["re"] == 1.0
