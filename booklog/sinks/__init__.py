"""Writers: replaceable batches, the merged cube, snapshots, publications, profiles."""
