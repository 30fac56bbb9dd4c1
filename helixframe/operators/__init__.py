"""DataFrame operators: joins on intervals, interval algebra, model fits, sampling, call-set comparison."""
