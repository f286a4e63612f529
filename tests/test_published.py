"""The published two-school example of measurement invariance, from its group moments."""

import numpy as np
import pytest

from gaugewright.functions.moments import BlockMoments
from gaugewright.operators.invariance import InvarianceLimits, invariance_of_moments

# Means and lower triangles of the covariance matrices of nine tests in two schools (156 and 145 pupils).
SCHOOLS = {
    "Pasteur": (
        156,
        "4.941239 5.983974 2.487179 2.822650 3.995192 1.922161 4.429208 5.563141 5.416132",
        """1.395230
        0.402103 1.503750
        0.620107 0.476758 1.345789
        0.567926 0.088504 0.164660 1.319686
        0.471940 0.142551 0.066445 1.079810 1.707910
        0.497563 0.194036 0.222102 0.755121 0.933921 0.974449
        0.045473 -0.203615 -0.024389 0.325563 0.175280 0.220979 1.164673
        0.165195 0.038512 0.151611 0.146989 0.151505 0.205647 0.423694 0.951991
        0.349713 0.218652 0.331457 0.155413 0.207619 0.184915 0.288559 0.353088 0.982050""",
    ),
    "Grant-White": (
        145,
        "4.929885 6.200000 1.995690 3.317241 4.712069 2.468966 3.920840 5.488276 5.327203",
        """1.318647
        0.414310 1.226379
        0.533750 0.478448 1.073365
        0.439868 0.283103 0.380965 1.257212
        0.411134 0.204569 0.344233 0.933298 1.341665
        0.412028 0.243892 0.407071 0.906397 0.898084 1.280142
        0.123285 0.075727 0.079681 0.241305 0.302994 0.208295 1.061800
        0.369523 0.194586 0.258570 0.121765 0.239728 0.143380 0.632835 1.094380
        0.573133 0.281398 0.395735 0.361459 0.422277 0.315245 0.441902 0.566652 1.051048""",
    ),
}


def test_two_schools():
    names = [f"x{k}" for k in range(1, 10)]
    groups = {}
    for school, (n, means, triangle) in SCHOOLS.items():
        cov = np.zeros((9, 9))
        cov[np.tril_indices(9)] = [float(v) for v in triangle.split()]
        cov = cov + cov.T - np.diag(np.diag(cov))
        groups[school] = BlockMoments(names, n, np.array([float(v) for v in means.split()]), cov)
    found = invariance_of_moments(groups, {"visual": names[:3], "textual": names[3:6], "speed": names[6:]}, InvarianceLimits(max_rmsea=0.10))
    levels = {r["level"]: r for r in found.levels}
    for level, chi, df in (("configural", 115.851, 48), ("metric", 124.044, 54), ("scalar", 164.103, 60)):
        assert levels[level]["chi_square"] == pytest.approx(chi, abs=0.2) and levels[level]["df"] == df and levels[level]["converged"]
    assert found.highest_supported == "metric"
