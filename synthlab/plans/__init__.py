"""Query plans: stand-in datasets on the test tables, registered queries, experiment runners."""
