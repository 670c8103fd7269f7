"""The scalar functions as SQL temporary functions, which Spark inlines into its own expressions."""

from __future__ import annotations

from pyspark.sql import SparkSession

_X, _Y = "x ARRAY<DOUBLE>", "y ARRAY<DOUBLE>"
_DOT = "aggregate(zip_with(x, y, (a, b) -> a * b), 0D, (s, v) -> s + v)"
_D2 = "aggregate(zip_with(x, y, (a, b) -> (a - b) * (a - b)), 0D, (s, v) -> s + v)"

#: name: (parameters, body). Divisions by zero and logarithms of nothing give null.
FUNCTIONS = {
    "sigmoid": ("x DOUBLE", "1 / (1 + exp(-x))"),
    "sigmoid_grad": ("x DOUBLE", "(1 / (1 + exp(-x))) * (1 - 1 / (1 + exp(-x)))"),
    "logit": ("p DOUBLE", "ln(try_divide(p, 1 - p))"),
    "tanh_grad": ("x DOUBLE", "1 - tanh(x) * tanh(x)"),
    "tanh_inverse": ("y DOUBLE", "0.5D * ln(try_divide(1 + y, 1 - y))"),
    "dot": (f"{_X}, {_Y}", _DOT),
    "squared_distance": (f"{_X}, {_Y}", _D2),
    "euclidean": (f"{_X}, {_Y}", f"sqrt({_D2})"),
    "kernel_linear": (f"{_X}, {_Y}, c DOUBLE", f"{_DOT} + c"),
    "kernel_polynomial": (f"{_X}, {_Y}, alpha DOUBLE, c DOUBLE, degree DOUBLE", f"power(alpha * {_DOT} + c, degree)"),
    "kernel_squared_exponential": (f"{_X}, {_Y}, length DOUBLE, amplitude DOUBLE", f"amplitude * exp(-try_divide({_D2}, 2 * length * length))"),
    "kernel_exponential": (f"{_X}, {_Y}, length DOUBLE, amplitude DOUBLE", f"amplitude * exp(-try_divide(sqrt({_D2}), 2 * length * length))"),
    "kernel_tanh": (f"{_X}, {_Y}, alpha DOUBLE, c DOUBLE", f"tanh(alpha * {_DOT} + c)"),
    "kernel_multiquadric": (f"{_X}, {_Y}, c DOUBLE", f"sqrt({_D2} + c * c)"),
    "kernel_rational_quadratic": (f"{_X}, {_Y}, alpha DOUBLE, length DOUBLE", f"power(1 + try_divide({_D2}, 2 * alpha * length * length), -alpha)"),
    "gaussian_log_density": ("x DOUBLE, mean DOUBLE, variance DOUBLE", "-0.5D * ln(2 * pi() * variance) - try_divide((x - mean) * (x - mean), 2 * variance)"),
    "cross_entropy": ("o DOUBLE, t DOUBLE", "-(t * ln(o) + (1 - t) * ln(1 - o))"),
    "squared_error": ("o DOUBLE, t DOUBLE", "(o - t) * (o - t)"),
    "step_sign": ("x DOUBLE", "CASE WHEN isnan(x) THEN NULL WHEN x >= 0 THEN 1D ELSE -1D END"),
}


def register(spark: SparkSession, prefix: str = "ts_") -> list[str]:
    """Registers all functions under prefix; returns their names."""
    for name, (parameters, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS DOUBLE RETURN {body}")
    return [f"{prefix}{n}" for n in FUNCTIONS]
