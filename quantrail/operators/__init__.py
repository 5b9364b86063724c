"""DataFrame operators: sampling, statistics, what-if analysis, fitting, time series, regression and optimisation."""
