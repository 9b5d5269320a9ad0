"""The engine's functions in one place."""

from .functions.provenance import Execution, Manifest, TensorRef, oid, scattering_manifest
from .functions.stats import dcorr2_exact, weighted_dcorr2
from .functions.training import Calibration, TaggerModel, TrainConfig
from .operators.signals import coeffs_long, features_from_r2, filters, fingerprint, fingerprint_clouds, path_mean, path_std, r2, reduce_coefficients, scatter, scatter_paths
from .operators.tables import AnomalyIndex, bench_report, calibrate, dcorr2, dcorr2_chunked, dcorr2_grad, predict, psum_columns, sw1_top_k, synthetic_dataset, train_tag
from .plans.certificate import issue as issue_certificate
from .plans.certificate import verify as verify_certificate
from .plans.conformance import cases as conformance_cases
from .plans.conformance import scatter_case as conformance_scatter_case
from .plans.conformance import selftest as conformance_selftest
from .plans.scattering import ScatterConfig, Scattering
from .sources.session import Session
from .sources.store import TensorStore
from .streaming.scatter import scatter_stream

__all__ = [n for n in dir() if not n.startswith("_")]
