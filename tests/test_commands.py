"""The command line and its kernels on small workloads."""

import pytest

from sparkernels import __main__ as command

SMALL = {"fast": (32,), "friendly": (1, 50), "gauss": (7, 20), "sort": (500,), "kmeans": (60, 4), "lu": (12,), "tsp": (6,), "nbody": (20, 2), "raytrace": (16, 9, 2)}


@pytest.mark.parametrize("kernel", sorted(command.KERNELS))
def test_kernels_run_on_generated_workloads(spark, kernel):
    assert command.run(spark, kernel, SMALL[kernel]) > 0


def test_wrong_arguments_are_refused(capsys):
    for args in (["walk"], ["sort", "--class", "gigantic"], ["sort", "--nthreads", "-1"]):
        with pytest.raises(SystemExit):
            command.main(args)
    assert "usage" in capsys.readouterr().err
