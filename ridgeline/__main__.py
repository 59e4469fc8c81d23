from ridgeline.cli import main

main()
