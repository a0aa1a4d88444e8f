"""DataFrame to DataFrame operators on fix tables, flights, catalogs and spectra."""
