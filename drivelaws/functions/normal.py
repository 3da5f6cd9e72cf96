"""Standard normal quantile and distribution as Column expressions (Spark has neither)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wichura's AS 241 (PPND16), highest power first.
CENTRE_NUM = (2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4,
              4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3,
              1.3314166789178437745e2, 3.3871328727963666080e0)
CENTRE_DEN = (5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4,
              2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2,
              4.2313330701600911252e1, 1.0)
TAIL_NUM = (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1,
            1.27045825245236838258e0, 3.64784832476320460504e0, 5.76949722146069140550e0,
            4.63033784615654529590e0, 1.42343711074968357734e0)
TAIL_DEN = (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2,
            1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e0,
            2.05319162663775882187e0, 1.0)
FAR_NUM = (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3,
           2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e0,
           5.46378491116411436990e0, 6.65790464350110377720e0)
FAR_DEN = (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5,
           7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1,
           5.99832206555887937690e-1, 1.0)

# Hart's rational approximation of the normal tail, highest power first.
HART_NUM = (3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383,
            112.079291497871, 221.213596169931, 220.206867912376)
HART_DEN = (8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461,
            296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
ROOT_TWO_PI = 2.5066282746310002


def poly(x: Column, coefficients: tuple[float, ...]) -> Column:
    """Horner evaluation, highest power first; folded over the coefficients, so x appears once."""
    return F.aggregate(F.array(*(F.lit(c) for c in coefficients)), F.lit(0.0), lambda acc, c: acc * x + c)


def probit(p: Column) -> Column:
    """Inverse of the standard normal distribution; -inf / inf at 0 / 1, null outside [0, 1]."""
    q = p - F.lit(0.5)
    inner = F.lit(0.180625) - q * q
    centre = q * poly(inner, CENTRE_NUM) / poly(inner, CENTRE_DEN)
    # ln is null for a non-positive argument, which is what the edges below rely on
    depth = F.sqrt(-F.ln(F.least(p, F.lit(1.0) - p)))
    near, far = depth - F.lit(1.6), depth - F.lit(5.0)
    tail = F.when(depth <= 5.0, poly(near, TAIL_NUM) / poly(near, TAIL_DEN)).otherwise(
        poly(far, FAR_NUM) / poly(far, FAR_DEN))
    return (
        F.when(p == 0.0, F.lit(float("-inf")))
        .when(p == 1.0, F.lit(float("inf")))
        .when((p > 0.0) & (p < 1.0),
              F.when(F.abs(q) <= 0.425, centre).when(q < 0.0, -tail).otherwise(tail))
    )


def normal_cdf(z: Column) -> Column:
    a = F.abs(z)
    bell = F.exp(-a * a / F.lit(2.0))
    close = bell * poly(a, HART_NUM) / poly(a, HART_DEN)
    chain = a + F.lit(0.65)
    for k in (4.0, 3.0, 2.0, 1.0):
        chain = a + F.lit(k) / chain
    beyond = bell / chain / F.lit(ROOT_TWO_PI)
    upper = F.when(a > 37.0, F.lit(0.0)).when(a < 7.07106781186547, close).otherwise(beyond)
    return F.when(z > 0.0, F.lit(1.0) - upper).otherwise(upper)


def normal_pdf(z: Column) -> Column:
    return F.exp(-z * z / F.lit(2.0)) / F.lit(ROOT_TWO_PI)
