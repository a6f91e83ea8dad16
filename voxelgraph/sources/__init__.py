"""Where voxel tables come from and go to."""
